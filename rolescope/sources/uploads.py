"""Checks of uploaded files and the events they raise."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators.quality import reject_reasons

MOST_BYTES = 10 * 1024 * 1024


def checked(uploads: DataFrame, suffixes: tuple[str, ...] = lexicon.RESUME_SUFFIXES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Uploads (filename, size_bytes, resume_id?) with ``resume_id``, ``stored_name`` and ``reject``.

    The id is the given one, else the file's stem, made safe. ``reject`` is null for a good upload, else the first
    reason: no name, bad suffix, empty, too large, no id.
    """
    name = text.basename(F.trim("filename"))
    given = F.nullif(F.trim("resume_id"), F.lit("")) if "resume_id" in uploads.columns else F.lit(None).cast("string")
    own = text.sanitised_id(F.coalesce(given, text.stem(name)))
    kind = text.suffix(name)
    reject = reject_reasons({
        "no name": F.coalesce(name == "", F.lit(True)), "bad suffix": ~kind.isin(*suffixes), "empty": F.coalesce(F.col("size_bytes") <= 0, F.lit(True)),
        "too large": F.col("size_bytes") > most_bytes, "no id": own.isNull(),
    })
    others = [c for c in uploads.columns if c not in ("resume_id", "source_filename", "stored_name", "reject")]
    return uploads.select(*others, own.alias("resume_id"), name.alias("source_filename"), F.concat(own, kind).alias("stored_name"), reject.alias("reject"))


def stored(files: DataFrame, folder: str) -> DataFrame:
    """Write files (``stored_name``, ``content``) into a folder of any file system that Arrow knows, each task its own, and give
    ``stored_name``, ``size_bytes`` and ``error``. A file that is there is replaced; it appears whole or not at all. Of rows with one
    name the longest content holds. Rows without a name or content are left out."""
    named = files.where("stored_name is not null and content is not null").select("stored_name", F.col("content").cast("binary").alias("content"))
    first = Window.partitionBy("stored_name").orderBy(F.length("content").desc(), F.sha2("content", 256))
    one = named.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("stored_name", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder.rstrip("/")))
        system.create_dir(base, recursive=True)
        for batch in batches:
            sizes, errors = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, error = content.as_py(), None
                try:
                    part = f"{base}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(data)
                    system.move(part, f"{base}/{name}")
                except OSError as failure:
                    error = f"{type(failure).__name__}: {failure}"[:500]
                sizes.append(len(data))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["stored_name", "size_bytes", "error"])

    return one.mapInArrow(run, "stored_name string, size_bytes bigint, error string")


def accepted(checked_uploads: DataFrame) -> DataFrame:
    return checked_uploads.where("reject is null")


def rejected(checked_uploads: DataFrame) -> DataFrame:
    return checked_uploads.where("reject is not null")


def upload_events(checked_uploads: DataFrame, folder: str, now=None) -> DataFrame:
    """``key`` and JSON ``value`` of the event of each good upload."""
    at = F.date_format(F.current_timestamp() if now is None else F.lit(now).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.struct("resume_id", "source_filename", F.concat(F.lit(folder.rstrip("/") + "/"), "stored_name").alias("source_path"), at.alias("uploaded_at"))
    return accepted(checked_uploads).select(F.col("resume_id").alias("key"), F.to_json(body).alias("value"))
