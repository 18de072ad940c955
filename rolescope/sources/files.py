"""Landing-zone readers: résumé files, job descriptions, label files."""

from __future__ import annotations

import io
import shutil
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text

EMPTY = "No text could be extracted from the source file."
UNSUPPORTED = "Unsupported format."


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = lexicon.AUDIT_SUFFIXES) -> DataFrame:
    """``path``, ``relative_path``, ``size_bytes``, ``modified_at`` and its ISO text of files below a folder, whatever their depth, by
    suffix in any case. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    relative = F.expr(f"substring_index(path, '{root.split(':', 1)[-1]}/', -1)")
    return files.where(text.suffix(F.col("path")).isin(*suffixes)).select("path", relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_iso"))


def contents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = lexicon.RESUME_SUFFIXES, limit: int | None = None) -> DataFrame:
    """``path``, ``content`` and ``modified_at`` of such files; ``limit`` keeps the first so many by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = files.where(text.suffix(F.col("path")).isin(*suffixes)).select("path", "content", F.col("modificationTime").alias("modified_at"))
    if limit is None:
        return wanted
    # The first paths are found without their contents.
    first = wanted.select("path").orderBy("path").limit(limit)
    return wanted.join(F.broadcast(first) if limit <= 10_000 else first, "path", "left_semi")


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs of a DOCX file, a line each."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    lines = ["".join(t.text or "" if t.tag == ns + "t" else "\t" if t.tag == ns + "tab" else "\n" if t.tag == ns + "br" else "" for t in p.iter()) for p in root.iter(ns + "p")]
    return "\n".join(line for line in lines if line.strip())


def pdf_text(content: bytes) -> str:
    """Text of a PDF as it is laid out, by pdftotext where that program is installed, else by pdfminer where that library is."""
    program = shutil.which("pdftotext")
    if program:
        return subprocess.run([program, "-layout", "-enc", "UTF-8", "-", "-"], input=content, capture_output=True, check=True, timeout=300).stdout.decode("utf-8", "replace")
    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(content))


EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pdf": pdf_text}


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``path``, normalised ``text``, ``file_sha256``, ``warnings`` and ``error`` of files (path, content).

    Plain text is decoded inside the JVM, bytes that are not UTF-8 left out; other formats go through their extractor
    in Arrow batches. A file that fails keeps its row with a null text and the error; an unknown suffix is an error.
    """
    chosen = EXTRACTORS if extractors is None else extractors
    kind = text.suffix(F.col("path"))
    plain = files.where(kind == ".txt").select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\uFFFD", "").alias("raw"), F.sha2("content", 256).alias("file_sha256"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time: files may be large
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                raw, error = None, None
                try:
                    extractor = chosen.get("." + path.rsplit(".", 1)[-1].lower())
                    if extractor is None:
                        raise ValueError(UNSUPPORTED)
                    raw = extractor(content or b"")
                except Exception as failure:  # noqa: BLE001 - a broken file must not stop the others
                    error = f"{type(failure).__name__}: {failure}"[:500]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([raw], pa.string()), batch.column(2).slice(k, 1), pa.array([error], pa.string())], names=["path", "raw", "file_sha256", "error"])

    other = files.where(kind != ".txt").select("path", "content", F.sha2("content", 256).alias("file_sha256")).mapInArrow(run, "path string, raw string, file_sha256 string, error string")
    both = plain.unionByName(other).withColumn("text", text.normalised(F.col("raw")))
    warned = F.array_compact(F.array(F.when(F.col("error").isNull() & (F.coalesce("text", F.lit("")) == ""), F.lit(EMPTY))))
    return both.select("path", "text", "file_sha256", warned.alias("warnings"), "error")


def job_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``job_id`` (the stem), ``source_path``, ``source_filename``, ``raw_text``, ``content_sha256`` of the text files
    directly in a folder."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True).select(F.input_file_name().alias("source_path"), F.col("value"))
    return files.select(text.stem(F.col("source_path")).alias("job_id"), "source_path", text.basename(F.col("source_path")).alias("source_filename"), text.strip(F.col("value")).alias("raw_text"), F.sha2("value", 256).alias("content_sha256"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned relevance labels of a JSON-lines file; a bad label or split is an error."""
    from ..operators.evaluation import clean_labels

    return clean_labels(json_lines(spark, path, "job_id string, resume_id string, label int, split string, source string, notes string"))
