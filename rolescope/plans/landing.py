"""Queries over files: each writes the files it reads into the shared folder, from the tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, text
from ..operators import evaluation, ranking
from ..session import checkpoint_root, cut, table
from ..sources import files, store, uploads
from .evaluating import _CLEAN, _labels
from .shortlist import _LATEST


def _folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))
    return p.select("resume_id", documents.text_at(documents.document(F.col("profile_json")), "$.raw_text").alias("t")).where("t is not null")


def _normal(x: str) -> str:
    """SQL of a text's normal form."""
    a = f"replace(regexp_replace(regexp_replace(translate({x}, '‣▪' || chr(61623) || chr(61607) || chr(160) || chr(12), '••••' || ' ' || chr(10)), '\\r\\n?', chr(10), 'g'), '[^\\S\\n]*\\n[^\\S\\n]*', chr(10), 'g'), chr(9), '    ')"
    return f"regexp_replace(regexp_replace(regexp_replace({a}, '[^\\S\\n]*\\n[^\\S\\n]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_RAW = _LATEST + ", t AS (SELECT resume_id, json_extract_string(d, '$.raw_text') AS t FROM prof WHERE json_extract_string(d, '$.raw_text') IS NOT NULL)"


def landed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of all profiles, stored, listed, read and normalised."""
    folder = _folder(spark, "landing")
    own = _texts(spark, sf_dir).select(F.concat("resume_id", F.lit(".txt")).alias("stored_name"), F.col("t").cast("binary").alias("content"))
    cut(uploads.stored(own, folder))
    read = files.extracted(files.contents(spark, folder))
    return read.select(text.stem(F.col("path")).alias("resume_id"), F.sha2("text", 256).alias("hash"), "file_sha256", F.size("warnings").alias("warnings"), F.col("error").isNull().alias("good"))


LANDED_SQL = _RAW + f"""
SELECT resume_id, sha256({_normal('t')}) AS hash, sha256(t) AS file_sha256, CAST(CASE WHEN {_normal('t')} = '' THEN 1 ELSE 0 END AS INTEGER) AS warnings, true AS good FROM t"""


def docx_of(paragraphs: list[str]) -> bytes:
    """A minimal DOCX file."""
    body = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<?xml version=\"1.0\" encoding=\"UTF-8\"?><w:document xmlns:w=\"http://schemas.openxmlformats.org/wordprocessingml/2006/main\"><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def landed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCX files of all jobs' titles, skills and ids, stored and read; a broken file beside them keeps its row with an error."""
    folder = _folder(spark, "documents")
    jobs = ranking.latest_jobs(table(spark, sf_dir, "job_descriptions")).select("job_id", F.coalesce("job_title", F.lit("")).alias("title"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [docx_of([title, "", f"Job {key}"]) for key, title in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.docx" for k in batch.column(0).to_pylist()]), pa.array(content, pa.binary())], names=["stored_name", "content"])

    made = jobs.mapInArrow(run, "stored_name string, content binary")
    broken = spark.createDataFrame([("broken.docx", bytearray(b"no archive"))], "stored_name string, content binary")
    cut(uploads.stored(made.unionByName(broken), folder))
    read = files.extracted(files.contents(spark, folder))
    return read.select(text.stem(F.col("path")).alias("job_id"), "text", F.col("error").isNull().alias("good"))


DOCUMENTS_SQL = _LATEST + """
SELECT job_id, trim(CASE WHEN trim(coalesce(job_title, '')) = '' THEN '' ELSE job_title || chr(10) END || 'Job ' || job_id) AS text, true AS good FROM job UNION ALL SELECT 'broken', NULL, false"""


def landed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job description files, stored and read."""
    folder = _folder(spark, "jobs")
    jobs = ranking.latest_jobs(table(spark, sf_dir, "job_descriptions")).where("raw_text is not null")
    cut(uploads.stored(jobs.select(F.concat("job_id", F.lit(".txt")).alias("stored_name"), F.col("raw_text").cast("binary").alias("content")), folder))
    return files.job_texts(spark, folder).select("job_id", "source_filename", F.sha2("raw_text", 256).alias("hash"), "content_sha256")


_BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"
JOBS_SQL = _LATEST + f"""
SELECT job_id, job_id || '.txt' AS source_filename, sha256(regexp_replace(raw_text, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS hash, sha256(raw_text) AS content_sha256 FROM job WHERE raw_text IS NOT NULL"""


def landed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned labels written as JSON lines with a manifest, and read back strictly."""
    path = _folder(spark, "labels")
    own = cut(_labels(spark, sf_dir))
    store.write_with_manifest(own, path, own.agg(F.count("*").alias("labels")))
    told = spark.read.json(f"{path}.manifest.json").first().labels  # one row
    return evaluation.label_counts(files.label_file(spark, path)).withColumn("told", F.lit(told).cast("bigint"))


LANDED_LABELS_SQL = _CLEAN + "\nSELECT coalesce(split, 'unspecified') AS split, label, count(*) AS labels, count(DISTINCT job_id) AS jobs, (SELECT count(*) FROM lab) AS told FROM lab GROUP BY 1, 2"


def ranking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each job's stored ranking as one JSON array a job, in a folder for each, read back."""
    path = _folder(spark, "rankings")
    rows = table(spark, sf_dir, "job_candidate_rankings").where("ranking_rank is not null and job_id is not null")
    own = rows.groupBy("job_id", "resume_id").agg(F.min("ranking_rank").alias("ranking_rank"))
    store.write_json(store.ranking_artifact(own), path, by="job_id")
    read = spark.read.schema("job_id string, ranking string").json(path)
    entries = F.from_json("ranking", "array<struct<ranking_rank int, resume_id string>>")
    return read.select("job_id", F.explode(entries).alias("e")).select("job_id", "e.ranking_rank", "e.resume_id")


RANKING_FILES_SQL = """
SELECT job_id, ranking_rank, resume_id FROM (SELECT job_id, resume_id, min(ranking_rank) AS ranking_rank FROM job_candidate_rankings WHERE ranking_rank IS NOT NULL AND job_id IS NOT NULL GROUP BY 1, 2) WHERE ranking_rank <= 10"""


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a landing folder by suffix, without reading them."""
    folder = _folder(spark, "listing")
    f = table(spark, sf_dir, "resume_files").where("file_id is not null").select(F.concat("file_id", F.coalesce("suffix", F.lit(""))).alias("stored_name"), F.lit("x").cast("binary").alias("content"))
    cut(uploads.stored(f, folder))
    return files.listed(spark, folder).groupBy(text.suffix(F.col("relative_path")).alias("suffix")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


LISTED_SQL = """
SELECT lower(suffix) AS suffix, count(*) AS files, CAST(count(*) AS BIGINT) AS bytes FROM (SELECT DISTINCT file_id, suffix FROM resume_files WHERE file_id IS NOT NULL) WHERE lower(suffix) IN ('.pdf', '.doc', '.docx', '.txt') GROUP BY 1"""


def queries() -> dict:
    own = [landed_texts, landed_documents, landed_jobs, landed_labels, ranking_files, listed_files]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {"landed_texts": LANDED_SQL, "landed_documents": DOCUMENTS_SQL, "landed_jobs": JOBS_SQL, "landed_labels": LANDED_LABELS_SQL, "ranking_files": RANKING_FILES_SQL, "listed_files": LISTED_SQL}
