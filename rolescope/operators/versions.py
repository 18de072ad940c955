"""Rows that hold: the latest version of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], version: str, tie: list[Column]) -> DataFrame:
    """The row of each key with the greatest ``version``.

    Null versions count as oldest. ``tie`` orders rows of equal version, so repeated rows leave exactly one and
    the choice does not depend on the arrival order. Built as a group limit of one: map tasks drop old rows
    before the shuffle. A null key is a key like any other; an empty table gives no rows.
    """
    order = [F.col(version).desc_nulls_last(), *tie]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_version_no", F.row_number().over(w)).where("_version_no = 1").drop("_version_no")
