"""Queries of the file audit and of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import audit
from ..session import cut, table
from ..sources import uploads


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.file_features(table(spark, sf_dir, "resume_files"))


def _words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda t: lower(t))"


def _unmarked(x: str) -> str:
    out = f"translate({x}, '_-', '  ')"
    for m in lexicon.FILE_MARKERS:
        out = f"regexp_replace({out}, '(?i){m}', ' ', 'g')"
    return out


_DROPPED = ", ".join(f"'{w}'" for w in (*lexicon.FILE_WORDS, *lexicon.MONTHS))
_FEATURES = f"""
WITH f AS (SELECT relative_path, max(size_bytes) AS size_bytes FROM resume_files WHERE relative_path IS NOT NULL GROUP BY 1),
n AS (SELECT *, regexp_replace(string_split(relative_path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(string_split(relative_path, '/')[-1], '.(\\.[^.]+)$', 1)) AS suffix_lower FROM f),
x AS (SELECT *, lower(stem) AS stem_lower, nullif(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), '') AS sanitized_id, regexp_replace(lower(stem), '[^a-z0-9]+', '', 'g') AS stem_compact,
  array_to_string({_words(_unmarked('stem'))}, '') AS marker_compact, list_filter({_words(_unmarked('stem'))}, lambda t: t NOT IN ({_DROPPED}) AND NOT regexp_matches(t, '^[0-9]+$')) AS tokens,
  len(list_filter({_words('stem')}, lambda t: t IN ('example', 'sample', 'template'))) > 0 AS is_template FROM n)"""


def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name features of every file."""
    return _features(spark, sf_dir).select("relative_path", "stem", "suffix_lower", "sanitized_id", "marker_compact", "candidate_key", "is_template", "is_informative")


FILE_KEYS_SQL = _FEATURES + """
SELECT relative_path, stem, suffix_lower, sanitized_id, marker_compact, array_to_string(tokens, ' ') AS candidate_key, is_template, len(tokens) >= 2 OR (len(tokens) = 1 AND length(array_to_string(tokens, '')) >= 7) AS is_informative FROM x"""


def audit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of every duplicate rule."""
    f = cut(_features(spark, sf_dir))
    out = None
    for rule in audit.RULES:
        own = audit.groups(f, rule)
        out = own if out is None else out.unionByName(own)
    return out


AUDIT_GROUPS_SQL = _FEATURES + """
SELECT 'same stem' AS rule, stem AS key, count(*) AS files FROM x WHERE stem <> '' GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'same id', sanitized_id, count(*) FROM x WHERE sanitized_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'extension only', stem, count(*) FROM x WHERE stem <> '' GROUP BY 2 HAVING count(*) > 1 AND count(DISTINCT suffix_lower) > 1
UNION ALL SELECT 'case only', stem_lower, count(*) FROM x WHERE stem <> '' GROUP BY 2 HAVING count(*) > 1 AND count(DISTINCT stem) > 1
UNION ALL SELECT 'marker', marker_compact, count(*) FROM x WHERE marker_compact <> '' GROUP BY 2 HAVING count(*) > 1 AND count(DISTINCT stem_lower) > 1 AND bool_or(marker_compact <> stem_compact)"""


def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(_features(spark, sf_dir))


def audit_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files whose person keys are alike."""
    return audit.near_links(_features(spark, sf_dir))


def audit_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that some evidence links, with their group and its size."""
    out = audit.review_groups(cut(_features(spark, sf_dir)))
    return out.select("group", "relative_path", "group_size", F.array_join("reasons", "; ").alias("reasons"))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(cut(_features(spark, sf_dir)))


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the audit table taken as uploads: outcomes of the checks."""
    files = table(spark, sf_dir, "resume_files").select("file_id", F.col("relative_path").alias("filename"), F.col("size_bytes"))
    return uploads.checked(files).select("file_id", "filename", "stored_name", "reject").distinct()


UPLOADS_SQL = r"""
WITH u AS (SELECT file_id, relative_path AS filename, size_bytes, string_split(trim(relative_path), '/')[-1] AS n FROM resume_files),
i AS (SELECT *, lower(regexp_extract(n, '.(\.[^.]+)$', 1)) AS s, nullif(regexp_replace(regexp_replace(regexp_replace(n, '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), '') AS id FROM u)
SELECT DISTINCT file_id, filename, id || s AS stored_name, CASE WHEN coalesce(n = '', true) THEN 'no name' WHEN s NOT IN ('.pdf', '.docx', '.txt') THEN 'bad suffix' WHEN coalesce(size_bytes <= 0, true) THEN 'empty'
  WHEN size_bytes > 10485760 THEN 'too large' WHEN id IS NULL THEN 'no id' END AS reject FROM i"""


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sizes of files are shown, counted by label."""
    files = table(spark, sf_dir, "resume_files")
    return files.groupBy(text.size_label(F.col("size_bytes")).alias("label")).agg(F.count("*").alias("files"))


LABELS_SQL = """SELECT CASE WHEN size_bytes < 1024 THEN format('{:d} B', size_bytes) WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS label, count(*) AS files FROM resume_files GROUP BY 1"""


def queries() -> dict:
    own = [file_keys, audit_groups, audit_totals, audit_near, audit_review, audit_report, upload_checks, display_labels]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "file_keys": FILE_KEYS_SQL, "audit_groups": AUDIT_GROUPS_SQL, "upload_checks": UPLOADS_SQL, "display_labels": LABELS_SQL,
        "audit_totals": _FEATURES + "\nSELECT count(*) AS total_files, count(DISTINCT stem) AS unique_stems, count(DISTINCT sanitized_id) AS unique_ids FROM x",
    }
