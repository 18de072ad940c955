"""One ranking from several differently scaled scores (problem 5).

Every signal becomes its rank inside the group, so units, ranges and outliers vanish. The first principal component
of the ranks, from a correlation matrix aggregated over all rows, weighs them; each loading takes the sign of the
direction declared for its signal, and items are sorted by their projection.

Ranks are exact, and no task sorts more than a bounded number of rows of a group. Groups are counted first; those within the bound
are ranked by windows that share one shuffle. The values of a larger group are counted per distinct value, cut at its own
approximate quantiles into buckets of bounded size, ranked inside the bucket, and shifted by the rows of the buckets before
it: the same ranks. Ties share one row there, so a value that holds a third of a group costs nothing extra.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import positions
from ..operators.versions import latest_rows
from ..session import cut
from .group_topn import top_n

#: Signals of a candidate and the direction in which each gets better.
SIGNALS = {"semantic_similarity": 1, "skill_coverage": 1, "experience_alignment": 1, "education_match": 1}
#: Rows of a group that one task ranks; larger groups are cut into buckets.
GROUP_ROWS = 500_000
#: Distinct values of a group and signal that are ranked in one task, about.
BUCKET_VALUES = 50_000
#: Quantiles at which a group with more distinct values than that is cut.
SPLITS = 256


def value_ranks(long: DataFrame, group: str, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """Mid-rank in (0, 1) of each distinct value of each (group, signal).

    ``long`` has columns ``group``, ``signal``, ``value`` without nulls. The rank of a value is (rows below it + half
    of the rows that share it) / rows, the same for any order of the input.
    """
    counted = long.groupBy(group, "signal", "value").agg(F.count("*").alias("n"))
    accuracy = F.lit(10_000)
    sizes = counted.groupBy(group, "signal").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_values"),
        F.percentile_approx("value", [k / SPLITS for k in range(1, SPLITS)], accuracy).alias("cuts"),
    )
    cuts = F.when(F.col("distinct_values") > bucket_values, F.col("cuts")).otherwise(F.expr("cast(array() as array<double>)"))
    sizes = sizes.withColumn("cuts", cuts)
    placed = counted.join(sizes, [group, "signal"]).withColumn("bucket", F.expr("size(filter(cuts, c -> c < value))"))
    inside = Window.partitionBy(group, "signal", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    shift = Window.partitionBy(group, "signal").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(group, "signal", "bucket").agg(F.sum("n").alias("_n"))
        .withColumn("offset", F.coalesce(F.sum("_n").over(shift), F.lit(0))).drop("_n")
    )
    rank = (F.col("offset") + F.col("before") + F.col("n") / 2) / F.col("rows")
    return local.join(offsets, [group, "signal", "bucket"]).select(group, "signal", "value", rank.alias("r"))


def _value(signal: str, sign: int) -> Column:
    """Signal ascending to better; null for null and NaN."""
    value = F.col(signal).cast("double") * sign + 0.0
    return F.when(~F.isnan(value), value)


def _in_buckets(items: DataFrame, group: str, item: str, signals: dict[str, int], bucket_values: int) -> DataFrame:
    """``ranked_signals`` of groups of any size."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), _value(s, sign).alias("value")) for s, sign in signals.items())))
    long = items.select(group, item, pairs.alias("x")).select(group, item, "x.signal", "x.value").where("value is not null")
    ranks = value_ranks(long.select(group, "signal", "value"), group, bucket_values)
    joined = long.join(ranks, [group, "signal", "value"])
    wide = joined.groupBy(group, item).agg(*(F.max(F.when(F.col("signal") == s, F.col("r") - 0.5)).alias(f"r_{s}") for s in signals))
    return items.select(group, item).join(wide, [group, item], "left")


def _in_windows(items: DataFrame, group: str, item: str, signals: dict[str, int]) -> DataFrame:
    """``ranked_signals`` of groups that a task can sort: one shuffle by the group."""
    whole = Window.partitionBy(group)
    ranks = []
    for s, sign in signals.items():
        value = _value(s, sign)
        order = whole.orderBy(value.asc_nulls_last())
        below, upto = F.rank().over(order) - 1, F.count(value).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ranks.append(F.when(value.isNotNull(), (below + upto) / 2 / F.count(value).over(whole) - 0.5).alias(f"r_{s}"))
    return items.select(group, item, *ranks)


def ranked_signals(items: DataFrame, group: str, item: str, signals: dict[str, int] = SIGNALS, large: DataFrame | None = None, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """``group``, ``item`` and ``r_<signal>`` of each row: its centred mid-rank in (-0.5, 0.5), ascending to better.

    A null or NaN signal has rank 0, the middle: it neither helps nor harms. A row without any signal keeps 0 everywhere.
    ``items`` has one row per (group, item). ``large`` holds the groups that are too large for one task.
    """
    if large is None or large.isEmpty():
        out = _in_windows(items, group, item, signals)
    else:
        small = _in_windows(items.join(large, group, "left_anti"), group, item, signals)
        out = small.unionByName(_in_buckets(items.join(large, group, "left_semi"), group, item, signals, bucket_values))
    return out.na.fill(0.0, [f"r_{s}" for s in signals])


def correlation(ranked: DataFrame, signals: dict[str, int] = SIGNALS) -> np.ndarray:
    """Correlation matrix of the centred ranks over all rows, from one aggregate row of sums."""
    names = list(signals)
    products = [F.sum(F.col(f"r_{a}") * F.col(f"r_{b}")).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = ranked.agg(*products).first()
    k = len(names)
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"{i}_{j}"] or 0.0
    sd = np.sqrt(np.diag(m))
    sd[sd == 0] = 1.0
    return m / np.outer(sd, sd)


def loadings(matrix: np.ndarray) -> np.ndarray:
    """Loadings of the first principal component, each with the sign of its declared direction (ranks already ascend
    to better, so all are non-negative), scaled to sum 1. A matrix of zeros gives equal loadings."""
    if not np.any(np.diag(matrix)):
        return np.full(len(matrix), 1 / len(matrix))
    _, vectors = np.linalg.eigh(matrix)
    first = np.abs(vectors[:, -1])
    return first / first.sum()


def fuse(items: DataFrame, group: str, item: str, signals: dict[str, int] = SIGNALS, large: DataFrame | None = None) -> DataFrame:
    """``group``, ``item``, the centred ranks and ``fused``, their projection on the first component."""
    ranked = cut(ranked_signals(items, group, item, signals, large))
    weights = loadings(correlation(ranked, signals))
    fused = reduce(lambda x, y: x + y, [F.col(f"r_{s}") * float(w) for s, w in zip(signals, weights, strict=True)])
    return ranked.withColumn("fused", F.round(fused, 12))


def joint_ranking(rankings: DataFrame, jobs: DataFrame | None = None, n: int | None = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Joint ranking of the latest candidates of each asked job, of all jobs if none are given, best first; ``n`` keeps the
    first of each job.

    The weights come from the candidates of all jobs, so a job's ranking does not depend on which jobs are asked. Jobs asked
    twice count once; asked jobs without candidates have no rows; null job ids match nothing. Equal projections are ordered by
    resume_id.
    """
    rows = rankings.where("job_id is not null").select("job_id", "resume_id", "updated_at", *SIGNALS)
    # Stored rows of a job are never fewer than its candidates; counted before the shuffle.
    large = rows.groupBy("job_id").agg(F.count("*").alias("rows")).where(F.col("rows") > group_rows).select("job_id")
    last = latest_rows(rows, ["job_id", "resume_id"], "updated_at", [F.col(s).desc_nulls_last() for s in SIGNALS])
    fused = fuse(last.drop("updated_at"), "job_id", "resume_id", large=large)
    if jobs is not None:
        fused = fused.join(jobs.select("job_id").where("job_id is not null").distinct(), "job_id", "left_semi")
    if n is None:
        return positions(fused, ["job_id"], [F.col("fused").desc(), F.col("resume_id").asc()], "pos")
    return top_n(fused, ["job_id"], "fused", [F.col("resume_id").asc()], n)
