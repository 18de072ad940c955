"""Quality counters of parsed profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents

# Members of a profile that may be missing.
FIELDS = ("name", "email", "phone", "skills", "education", "experience", "projects")


def missing_fields(profiles: DataFrame) -> DataFrame:
    """``source_filename`` and ``field`` of each member that a profile lacks: null, blank, zero and empty count as missing."""
    doc = documents.document(F.col("profile_json"))
    text = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    empty = lambda path: F.size(documents.entries(doc, path)) == 0
    lacks = {"name": text("name"), "email": text("email"), "phone": text("phone"), "skills": F.coalesce(F.size("skills"), F.lit(0)) <= 0, "education": empty("$.education"), "experience": empty("$.experience"), "projects": empty("$.projects")}
    fields = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in lacks.items())))
    return profiles.select("source_filename", F.explode(fields).alias("field"))


def warnings(profiles: DataFrame) -> DataFrame:
    """``source_filename`` and ``warning`` of each warning of the parser."""
    doc = documents.document(F.col("profile_json"))
    texts = F.filter(F.transform(documents.entries(doc, "$.metadata.warnings"), lambda w: F.try_variant_get(w, "$", "string")), lambda w: w.isNotNull())
    return profiles.select("source_filename", F.explode(texts).alias("warning"))


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("profiles"))


def examples(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` file names of each key; a group limit prunes before the shuffle."""
    w = Window.partitionBy(key).orderBy("source_filename")
    return df.distinct().withColumn("example", F.row_number().over(w)).where(F.col("example") <= limit)


def field_summary(profiles: DataFrame) -> DataFrame:
    """Missing members in one pass without exploding: one row for each field, fields that nobody lacks included."""
    doc = documents.document(F.col("profile_json"))
    text = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    empty = lambda path: F.size(documents.entries(doc, path)) == 0
    lacks = [text("name"), text("email"), text("phone"), F.coalesce(F.size("skills"), F.lit(0)) <= 0, empty("$.education"), empty("$.experience"), empty("$.projects")]
    sums = profiles.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f) for f, c in zip(FIELDS, lacks, strict=True)))
    return sums.select(F.expr(f"stack({len(FIELDS)}, {', '.join(f'{chr(39)}{f}{chr(39)}, `{f}`' for f in FIELDS)}) as (field, profiles)"))


def run_manifest(outcomes: DataFrame) -> DataFrame:
    """Processed, persisted and failed files of a run from (path, status, error)."""
    of = lambda status: F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0))
    return outcomes.agg(F.count("*").alias("processed"), of("persisted").alias("persisted"), of("failed").alias("failed"))


def run_failures(outcomes: DataFrame) -> DataFrame:
    """Failed files of a run and their errors, a row each: their number has no bound, so they are never gathered."""
    return outcomes.where("status = 'failed'").select("path", "error")


def reject_reasons(checks: dict[str, object]):
    """First failed check of a row as a column; null for a row that passes all."""
    return reduce(lambda chain, item: chain.when(item[1], F.lit(item[0])) if chain is not None else F.when(item[1], F.lit(item[0])), checks.items(), None)
