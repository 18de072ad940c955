"""Profiles from résumé texts: native expressions where they fit, one Arrow pass for the sections' irregular entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import resume, text

PARTS = (
    "name string, skills array<string>, education array<struct<raw_text:string,degree:string,institution:string,year:string,score:string>>, "
    "experience array<struct<raw_text:string,title:string,organization:string,date_range:string,description:string>>, certifications array<string>, "
    "projects array<struct<raw_text:string,name:string,description:string,technologies:array<string>>>, sections map<string,string>"
)
VERSION = "1"


def _struct(names: str, listed: str = "") -> pa.StructType:
    return pa.struct([(n, pa.list_(pa.string()) if n == listed else pa.string()) for n in names.split()])


_TYPES = {
    "name": pa.string(), "skills": pa.list_(pa.string()), "education": pa.list_(_struct("raw_text degree institution year score")),
    "experience": pa.list_(_struct("raw_text title organization date_range description")), "certifications": pa.list_(pa.string()),
    "projects": pa.list_(_struct("raw_text name description technologies", "technologies")), "sections": pa.map_(pa.string(), pa.string()),
}


def parsed_parts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key`` and the extracted parts of each text; null texts have null name and empty parts. Narrow: no shuffle."""
    source = df.select(key, F.coalesce(text_col, F.lit("")).alias("_text"))
    key_type = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                rows = [resume.parsed(t) for t in part.column(1).to_pylist()]
                arrays = []
                for name, kind in _TYPES.items():
                    values = [r[name] for r in rows]
                    if name in ("education", "experience", "projects"):
                        fields = [f.name for f in kind.value_type]
                        values = [[dict(zip(fields, e, strict=True)) for e in v] for v in values]
                    arrays.append(pa.array(values, kind))
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[key, *_TYPES])

    return source.mapInArrow(run, f"`{key}` {key_type}, {PARTS}")


def profiles(texts: DataFrame, now=None) -> DataFrame:
    """Profile rows from extracted texts (path, text, file_sha256, warnings).

    The id is the file's stem. ``now`` is the parse time, the current time by default. Files whose stems are equal make
    rows with equal ids; ``sources.store.first_of_stem`` decides among them.
    """
    base = texts.select("path", F.coalesce("text", F.lit("")).alias("text"), "file_sha256", F.coalesce("warnings", F.expr("cast(array() as array<string>)")).alias("warnings"))
    parts = parsed_parts(base, "path", "text")
    joined = base.join(parts, "path")
    email, phone = text.primary_email(F.col("text")), text.primary_phone(F.col("text"))
    lacks = F.array_compact(F.array(
        F.when(F.col("name").isNull(), F.lit("Name could not be extracted confidently.")), F.when(F.col("email").isNull(), F.lit("Email address not found.")), F.when(F.size("skills") == 0, F.lit("No skills detected.")),
    ))
    full = joined.withColumn("email", email).withColumn("phone", phone).withColumn("resume_id", text.stem(F.col("path"))).withColumn("source_filename", text.basename(F.col("path")))
    full = full.withColumn("warnings", F.concat("warnings", lacks)).withColumn("parsed_at", F.current_timestamp() if now is None else F.lit(now).cast("timestamp"))
    metadata = F.struct(F.regexp_replace(text.suffix(F.col("path")), r"^\.", "").alias("file_type"), F.col("file_sha256").alias("source_sha256"), F.length("text").alias("text_length"), "warnings")
    document = F.to_json(F.struct("resume_id", F.col("path").alias("source_path"), "source_filename", "parsed_at", "name", "email", "phone", "skills", "education", "experience", "certifications", "projects", "sections", F.col("text").alias("raw_text"), metadata.alias("metadata")))
    return full.select(
        "resume_id", "source_filename", F.col("path").alias("source_path"), F.col("file_sha256").alias("source_sha256"), F.lit(VERSION).alias("parser_version"), "parsed_at", "name", "email", "phone", "skills",
        F.size("education").alias("education_count"), F.size("experience").alias("experience_count"), F.size("projects").alias("project_count"), F.size("warnings").alias("warning_count"), document.alias("profile_json"),
    )
