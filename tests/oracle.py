"""Comparison of a registered query with its SQL on DuckDB, insensitive to the order of rows and columns."""

from __future__ import annotations

import glob
import os

import numpy as np
import pandas as pd


def plain(v) -> str:
    if isinstance(v, list | np.ndarray):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float | np.floating) and np.isnan(v):
        return "NULL"
    if isinstance(v, float | np.floating):
        return f"{float(v):.6g}" if v != 0 else "0"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | np.integer):
        return str(int(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


def duck(folder: str):
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(folder + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def check(spark, queries: dict, sql: dict, name: str, folder: str) -> None:
    mine = queries[name](spark, folder).toPandas()
    theirs = duck(folder).sql(sql[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
