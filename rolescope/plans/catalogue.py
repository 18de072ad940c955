"""Catalogue of registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import auditing, evaluating, landing, nested, serving, shortlist, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (shortlist, texts, auditing, evaluating, serving, nested, landing)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explainable shortlist: retrieved pairs joined with jobs and profiles, scored and ranked."""
    return shortlist.shortlist(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
