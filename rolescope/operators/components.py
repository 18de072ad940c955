"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and joins over the edges; no component, node list or edge list reaches the driver.
A round's result is written to the shared checkpoint folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the least node it is connected with, of each node that has an edge.

    Edges have no direction; loops, repeated edges and edges with a null end add nothing. No edges, no rows.
    RuntimeError if ``max_rounds`` rounds are not enough (rounds grow with the logarithm of the longest path).
    """
    now = cut(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = _fingerprint(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = cut(_small_star(_large_star(now)))
        mark = _fingerprint(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    # Stable: every edge leads from a node to the least node of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
