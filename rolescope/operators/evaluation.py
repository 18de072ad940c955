"""Offline evaluation of rankings against graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, split_name, strip

#: Rank that stands for a missing one; zero counts as missing.
NO_RANK = 1_000_000_000


def clean_labels(labels: DataFrame, strict: bool = True) -> DataFrame:
    """Labels with trimmed ids, canonical split and blank source and notes as null.

    ``strict`` makes a null or negative label and an unknown split an error, whichever columns are read later; otherwise such
    labels are left out and such splits null.
    """
    if strict:
        good = F.coalesce(F.col("label").cast("int") >= 0, F.lit(False))
        known = F.coalesce(split_name(F.col("split")), F.lit("")).isNotNull()
        labels = labels.where(F.when(good, known).otherwise(F.raise_error(F.lit("a label is null or negative")).cast("boolean")))
    out = labels.select(
        strip(F.col("job_id").cast("string")).alias("job_id"), strip(F.col("resume_id").cast("string")).alias("resume_id"), F.col("label").cast("int").alias("label"),
        split_name(F.col("split"), strict=False).alias("split"), blank_to_null(F.col("source")).alias("source"), blank_to_null(F.col("notes")).alias("notes"),
    )
    return out if strict else out.where("label >= 0")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unique_or_error(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unchanged; an error when a key occurs twice. One shuffle on the keys, which a following join on them reuses."""
    n = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    return df.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_n")


def label_summary(labels: DataFrame) -> DataFrame:
    """One row: labels, distinct jobs and résumés, and counts of each split (``unspecified`` for null) and label."""
    totals = labels.agg(F.count("*").alias("label_count"), F.countDistinct("job_id").alias("job_count"), F.countDistinct("resume_id").alias("resume_count"))

    def counts(column, name: str) -> DataFrame:
        grouped = labels.groupBy(column.alias("k")).agg(F.count("*").alias("n"))
        return grouped.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    one = F.lit(1).alias("one")
    frames = [totals.withColumn("one", one), counts(F.coalesce("split", F.lit("unspecified")), "split_counts").withColumn("one", one), counts(F.col("label").cast("string"), "label_counts").withColumn("one", one)]
    return frames[0].join(frames[1], "one").join(frames[2], "one").drop("one")


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels of each split and grade."""
    return labels.groupBy(F.coalesce("split", F.lit("unspecified")).alias("split"), "label").agg(F.count("*").alias("labels"), F.countDistinct("job_id").alias("jobs"))


def by_score_field(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each labelled pair and each score it has: ``score_field``, ``score``."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in fields)
    kept = [c for c in ("job_id", "resume_id", "label", "retrieval_rank") if c in rows.columns]
    return rows.select(*kept, F.expr(f"stack({len(fields)}, {pairs}) as (score_field, score)")).where("score is not null and label is not null")


def job_metrics(rows: DataFrame, precision_at: int = 5, recall_at: int = 10, ndcg_at: int = 10, least_label: int = 1) -> DataFrame:
    """Precision, recall and NDCG of each job and score field from (job_id, resume_id, label, retrieval_rank,
    score_field, score).

    Rows are ordered by score, then retrieval rank (missing and zero last), then id; precision divides by the rows
    there are if fewer than asked. Totals are partial sums and only the first positions of either order are needed, so
    group limits prune a job of any size before the shuffle.
    """
    deepest = max(precision_at, recall_at, ndcg_at)
    rank = F.when(F.coalesce("retrieval_rank", F.lit(0)) == 0, NO_RANK).otherwise(F.col("retrieval_rank"))
    group = ["score_field", "job_id"]
    by_score = Window.partitionBy(*group).orderBy(F.col("score").desc(), rank, "resume_id")
    by_label = Window.partitionBy(*group).orderBy(F.col("label").desc())
    hit = F.col("label") >= least_label
    gain = (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col("at") + 1)
    totals = rows.groupBy(*group).agg(F.count("*").alias("labeled_pair_count"), F.sum(hit.cast("long")).alias("relevant_pair_count"))
    found = rows.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= deepest).groupBy(*group).agg(
        F.sum((hit & (F.col("at") <= precision_at)).cast("long")).alias("p_hits"), F.sum((hit & (F.col("at") <= recall_at)).cast("long")).alias("r_hits"),
        F.coalesce(F.sum(F.when(F.col("at") <= ndcg_at, gain)), F.lit(0.0)).alias("dcg"),
    )
    ideal = rows.withColumn("at", F.row_number().over(by_label)).where(F.col("at") <= ndcg_at).groupBy(*group).agg(F.sum(gain).alias("ideal"))
    sums = totals.join(found, group).join(ideal, group)
    return sums.select(
        *group, "labeled_pair_count", "relevant_pair_count", F.round(F.col("p_hits") / F.least(F.lit(precision_at), F.col("labeled_pair_count")), 6).alias("precision_at_k"),
        F.when(F.col("relevant_pair_count") > 0, F.round(F.col("r_hits") / F.col("relevant_pair_count"), 6)).otherwise(0.0).alias("recall_at_k"),
        F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 6)).otherwise(0.0).alias("ndcg_at_k"),
    )


def mean_metrics(per_job: DataFrame) -> DataFrame:
    """Means over jobs of the rounded metrics of each score field."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return per_job.groupBy("score_field").agg(
        F.count("*").alias("jobs_with_labels"), F.sum((F.col("relevant_pair_count") > 0).cast("long")).alias("jobs_with_relevant_labels"),
        F.sum("labeled_pair_count").alias("labeled_pair_count"), mean("precision_at_k"), mean("recall_at_k"), mean("ndcg_at_k"),
    )


def labelled_export(scored: DataFrame, labels: DataFrame, only_labelled: bool = False) -> DataFrame:
    """One row for each scored pair with its label, split and source; labels of pairs that were not scored are dropped.

    A pair without a label keeps nulls, and the split of its job, unless ``only_labelled``. A pair that is labelled
    twice is an error.
    """
    from ..functions.scoring import split_bucket

    unique = unique_or_error(labels.select("job_id", "resume_id", "label", "split", "source"), ["job_id", "resume_id"])
    out = scored.join(unique, ["job_id", "resume_id"], "inner" if only_labelled else "left")
    return out.withColumn("split", F.coalesce("split", split_bucket(F.col("job_id"))))


def export_summary(export: DataFrame) -> DataFrame:
    return export.agg(F.count("*").alias("rows"), F.countDistinct("job_id").alias("jobs"), F.count("label").alias("labelled_rows"))
