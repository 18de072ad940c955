"""Top N items of every group (problem 7).

A ``row_number`` window ordered by score and identifiers with a rank filter: the optimiser turns the pair into
a partial group limit before the shuffle and a final one after it, so a group of millions of rows sends at most
N rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.versions import latest_rows


def top_n(df: DataFrame, group: list[str], score: str, ties: list[Column], n: int, position: str = "pos") -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``; ``position`` numbers them from 1.

    Rows with a null (or NaN) score take no part. Equal scores are ordered by ``ties``; with ties that identify a
    row the result is the same on every run. Groups with fewer than ``n`` scored rows return all of them, empty
    input returns no rows. A column that is called ``position`` already is replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *ties)
    return scored.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


def best_candidates(rankings: DataFrame, n: int = 10) -> DataFrame:
    """``p7_found``: the ``n`` best candidates of each job over the latest row of each pair."""
    rows = rankings.select("job_id", "resume_id", "final_score", "retrieval_rank", "updated_at")
    last = latest_rows(
        rows, ["job_id", "resume_id"], "updated_at",
        [F.col("final_score").desc_nulls_last(), F.col("retrieval_rank").asc_nulls_last()],
    )
    top = top_n(last, ["job_id"], "final_score", [F.col("retrieval_rank").asc_nulls_last(), F.col("resume_id").asc()], n)
    return top.select("job_id", "resume_id", F.col("pos").cast("int").alias("pos"))
