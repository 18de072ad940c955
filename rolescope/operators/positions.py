"""Positions of all rows within their group, for groups that no single task should sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, parallelism


def _numbered(df: DataFrame, group: list[str]) -> DataFrame:
    """``df``, sorted within its partitions by group, with ``_part`` and ``_at``, the place of a row in its group's run from 1."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = [df.columns.index(g) for g in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for k in at:
                codes = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                begins[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in at)
            begins[0] = first != last
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(begins, row, -before))
            place = row - start + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "_at"])
            last, before = tuple(batch.column(k)[n - 1].as_py() for k in at), int(place[-1])

    return df.mapInArrow(run, f"{schema}, _at bigint").withColumn("_part", F.spark_partition_id())


def positions(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``, the place of each row in its group from 1, as ``row_number`` would give it.

    Rows are parted by ranges of (group, order), so a group that holds a third of all rows lies in a third of the tasks; each
    part is sorted and numbered where it lies. Only a group that began in a part before is shifted, by the rows that it has
    there: at most one group a part, so the table of shifts has fewer rows than there are parts. ``order`` should
    identify a row of a group; rows that it does not tell apart are numbered in any order. Null groups are a group. A column
    that is called ``out`` already is replaced. ``df`` is read twice, once to find the ranges: cut what is dear to compute.
    """
    parts = parallelism(df.sparkSession)
    keys = [F.col(g) for g in group]
    placed = df.drop(out).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    numbered = cut(_numbered(placed, group))
    ends = numbered.groupBy("_part").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"), F.count("*").alias("rows"))
    tails = numbered.groupBy("_part", *group).agg(F.count("*").alias("_n")).join(ends.select("_part", "low", "high"), "_part")
    edge = tails.where(F.struct(*keys).eqNullSafe(F.col("low")) | F.struct(*keys).eqNullSafe(F.col("high")))
    # Rows of a group in the parts before: at most two groups of a part, its first and its last, are counted.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = edge.withColumn("_shift", F.sum("_n").over(before)).where("_shift > 0")
    shifts = shifts.select(F.col("_part").alias("_of"), *(F.col(g).alias(f"_g_{g}") for g in group), "_shift")
    same = F.col("_part") == F.col("_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    # One row a part at most: small whatever the table.
    joined = numbered.join(F.broadcast(shifts), same, "left")
    return joined.select(*(F.col(c) for c in df.columns if c != out), (F.col("_at") + F.coalesce("_shift", F.lit(0))).cast("int").alias(out))
