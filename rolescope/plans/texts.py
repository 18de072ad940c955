"""Queries over texts: normal forms, sections, blocks, job parts, lexicons, contacts, parsing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, lexicon, text
from ..operators import profiles, quality, ranking, sections
from ..session import table

#: The skill lexicon, and words that job adverts and notes hold.
WORDS = lexicon.SKILLS | {"reports": "Reports", "schedules": "Schedules", "budgets": "Budgets", "invoices": "Invoices", "contracts": "Contracts", "recruiter": "Recruiter", "monthly invoices": "Invoices a month"}

_PROF = """
WITH prof AS (
  SELECT *, CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d FROM (
    SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v FROM candidate_profiles WHERE resume_id IS NOT NULL) WHERE v = 1
), line AS (
  SELECT resume_id, unnest(range(len(l))) AS line_no, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS line
  FROM (SELECT resume_id, string_split_regex(json_extract_string(d, '$.raw_text'), '\\r\\n|[\\n\\r]') AS l FROM prof WHERE json_extract_string(d, '$.raw_text') IS NOT NULL)
)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))
    return p.select("resume_id", documents.text_at(documents.document(F.col("profile_json")), "$.raw_text").alias("raw_text"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("n", text.normalised(F.col("text")))
    return d.select("doc_id", F.length("n").alias("chars"), F.sha2("n", 256).alias("hash"))


NORMALISED_SQL = r"""
WITH a AS (SELECT doc_id, replace(regexp_replace(regexp_replace(translate(text, '‣▪' || chr(61623) || chr(61607) || chr(160) || chr(12), '••••' || ' ' || chr(10)), '\r\n?', chr(10), 'g'), '[^\S\n]*\n[^\S\n]*', chr(10), 'g'), chr(9), '    ') AS t FROM documents),
n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[^\S\n]*\n[^\S\n]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS n FROM a)
SELECT doc_id, length(n) AS chars, sha256(n) AS hash FROM n"""


def _heading_sql(line: str) -> str:
    form = f"trim(regexp_replace(lower(regexp_replace(regexp_replace({line}, '^[•●▪◦■*–—§\\-\\s]+', ''), '^\\s+|\\s+$', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    branches = []
    for name, aliases in lexicon.SECTIONS.items():
        held = " OR ".join(f"(f = '{a}' OR (contains(f, '{a}') AND list_has_all(string_split(f, ' '), string_split('{a}', ' '))))" for a in aliases)
        branches.append(f"WHEN {held} THEN '{name}'")
    return form, "CASE WHEN f = '' OR length(f) > 40 THEN NULL " + " ".join(branches) + " END"


_FORM, _SECTION = _heading_sql("line")
_FILLED = _PROF + f""", headed AS (SELECT resume_id, line_no, line, {_SECTION} AS s FROM (SELECT *, {_FORM} AS f FROM line)),
filled AS (SELECT resume_id, line_no, line, s, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section FROM headed)"""


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each section of each profile's text, by forward fill of the headings."""
    own = sections.sectioned(sections.lines(_raw(spark, sf_dir), "resume_id", "raw_text"), "resume_id")
    return own.groupBy("resume_id", "section").agg(F.count("*").alias("lines"), F.max("line_no").alias("last_line"))


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sections.section_texts(sections.lines(_raw(spark, sf_dir), "resume_id", "raw_text"), "resume_id")
    return own.select("resume_id", "section", F.sha2("text", 256).alias("hash"))


SECTION_TEXTS_SQL = _FILLED + r"""
SELECT resume_id, section, sha256(t) AS hash FROM (
  SELECT resume_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS t FROM filled WHERE s IS NULL GROUP BY 1, 2) WHERE t <> ''"""


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each profile's text: blank lines part them, a line with a span of years begins one."""
    numbered = sections.lines(_raw(spark, sf_dir), "resume_id", "raw_text")
    own = sections.blocks(numbered, ["resume_id"], F.col("line").rlike(r"(?:19|20)\d{2}\s*(?:-|–|to)\s*(?:19|20)\d{2}"))
    return own.groupBy("resume_id", "block").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


BLOCKS_SQL = _PROF + r""", b AS (
  SELECT resume_id, line_no, line, sum(CASE WHEN line = '' OR regexp_matches(line, '(?:19|20)[0-9]{2}\s*(?:-|–|to)\s*(?:19|20)[0-9]{2}') THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM line
), d AS (SELECT *, dense_rank() OVER (PARTITION BY resume_id ORDER BY b) AS block FROM b WHERE line <> '')
SELECT resume_id, CAST(block AS INTEGER) AS block, count(*) AS lines, CAST(min(line_no) AS INTEGER) AS first_line FROM d GROUP BY 1, 2"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("resume_id", text.primary_email(F.col("raw_text")).alias("email"), text.primary_phone(F.col("raw_text")).alias("phone"))


CONTACTS_SQL = _PROF + r""", c AS (
  SELECT resume_id, json_extract_string(d, '$.raw_text') AS t, list_filter(regexp_extract_all(json_extract_string(d, '$.raw_text'), '\+?[0-9][0-9 ()-]{8,}[0-9]'), lambda p: len(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15) AS p FROM prof)
SELECT resume_id, lower(nullif(regexp_extract(t, '[\p{L}\p{M}\p{Nd}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Pc}-]+(?:\.[\p{L}\p{M}\p{Nd}\p{Pc}-]+)+'), '')) AS email,
  CASE WHEN len(p) > 0 THEN CASE WHEN starts_with(p[1], '+') THEN '+' ELSE '' END || regexp_replace(p[1], '[^0-9]', '', 'g') END AS phone FROM c"""


def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each word of a lexicon, as whole words in any case."""
    d = table(spark, sf_dir, "documents").select(F.explode(text.lexicon_hits(F.col("text"), WORDS)).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("documents"))


_NO_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
LEXICON_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS term, count(*) AS documents FROM documents WHERE regexp_matches(lower(text), '(^|{_NO_WORD}){re.escape(alias).replace(chr(39), chr(39) * 2)}({_NO_WORD}|$)') HAVING count(*) > 0"
    for name, alias in {name: alias for alias, name in WORDS.items()}.items()
)


def job_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the latest job texts."""
    jobs = ranking.latest_jobs(table(spark, sf_dir, "job_descriptions"))
    parts = sections.job_parts(jobs)
    return parts.select("job_id", "job_title", "location", F.size("responsibilities").alias("duties"), F.array_join("required_skills", "|").alias("required"), F.array_join("preferred_skills", "|").alias("preferred"))


JOB_PARTS_SQL = r"""
WITH job AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v FROM job_descriptions WHERE job_id IS NOT NULL) WHERE v = 1),
l AS (SELECT job_id, unnest(range(len(x))) AS n, regexp_replace(unnest(x), '^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+$', '', 'g') AS line FROM (SELECT job_id, string_split_regex(raw_text, '\r\n|[\n\r]') AS x FROM job WHERE raw_text IS NOT NULL)),
m AS (SELECT *, CASE WHEN starts_with(line, 'Job Title:') THEN 'job_title' WHEN starts_with(line, 'Location:') THEN 'location' WHEN starts_with(line, 'Employment Type:') THEN 'employment_type' WHEN starts_with(line, 'Experience Required:') THEN 'experience_required' END AS label,
  CASE lower(trim(regexp_replace(line, ':+$', ''))) WHEN 'about the role' THEN 'about' WHEN 'key responsibilities' THEN 'responsibilities' WHEN 'required skills' THEN 'required_skills' WHEN 'preferred skills' THEN 'preferred_skills' WHEN 'education' THEN 'education' WHEN 'good fit indicators' THEN 'good_fit_indicators' END AS heading FROM l WHERE line <> ''),
s AS (SELECT *, last_value(CASE WHEN label IS NOT NULL THEN '' ELSE heading END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM m),
i AS (SELECT *, regexp_replace(regexp_replace(line, '^-', ''), '^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+$', '', 'g') AS item, label IS NULL AND heading IS NULL AS is_item, regexp_replace(regexp_replace(line, '^[^:]*:', ''), '^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+$', '', 'g') AS val FROM s)
SELECT job_id, max_by(CASE WHEN label = 'job_title' THEN val END, CASE WHEN label = 'job_title' THEN n END) AS job_title, max_by(CASE WHEN label = 'location' THEN val END, CASE WHEN label = 'location' THEN n END) AS location,
  CAST(count(*) FILTER (is_item AND section = 'responsibilities') AS INTEGER) AS duties, coalesce(string_agg(item, '|' ORDER BY n) FILTER (is_item AND section = 'required_skills'), '') AS required,
  coalesce(string_agg(item, '|' ORDER BY n) FILTER (is_item AND section = 'preferred_skills'), '') AS preferred FROM i GROUP BY job_id"""


def skill_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the skills section of each profile."""
    p = ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))
    line = documents.text_at(documents.document(F.col("profile_json")), "$.sections.skills")
    return p.select("resume_id", F.size(text.skill_candidates(line)).alias("tokens")).where("tokens >= 0")


SKILL_TOKENS_SQL = _PROF + r"""
SELECT resume_id, CAST(len(list_filter(list_transform(string_split_regex(CASE WHEN contains(s, ':') THEN regexp_replace(s, '^[^:]*:', '') ELSE s END, '(?i)[,/|]|\s+\band\b\s+'), lambda p: regexp_replace(p, '^[ .;:-]+|[ .;:-]+$', '', 'g')), lambda p: p <> '')) AS INTEGER) AS tokens
FROM (SELECT resume_id, json_extract_string(d, '$.sections.skills') AS s FROM prof) WHERE s IS NOT NULL"""


def profile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured parts parsed anew from the text of every profile."""
    parts = profiles.parsed_parts(_raw(spark, sf_dir), "resume_id", "raw_text")
    return parts.select("resume_id", "name", F.size("skills").alias("skills"), F.size("education").alias("education"), F.size("experience").alias("experience"), F.size("projects").alias("projects"), F.size("certifications").alias("certifications"))


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_summary(table(spark, sf_dir, "candidate_profiles"))


_EMPTY = lambda p: f"CASE WHEN json_type(d, '$.{p}') IS NULL OR json_type(d, '$.{p}') = 'NULL' OR json_array_length(d, '$.{p}') = 0 AND json_type(d, '$.{p}') = 'ARRAY' THEN 1 ELSE 0 END"
MISSING_SQL = f"""
WITH p AS (SELECT *, CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d FROM candidate_profiles)
SELECT unnest(['name', 'email', 'phone', 'skills', 'education', 'experience', 'projects']) AS field, CAST(unnest([
  (SELECT count(*) FROM p WHERE coalesce(trim(name) = '', true)), (SELECT count(*) FROM p WHERE coalesce(trim(email) = '', true)), (SELECT count(*) FROM p WHERE coalesce(trim(phone) = '', true)),
  (SELECT count(*) FROM p WHERE coalesce(len(skills), 0) = 0), (SELECT sum({_EMPTY('education')}) FROM p), (SELECT sum({_EMPTY('experience')}) FROM p), (SELECT sum({_EMPTY('projects')}) FROM p)]) AS BIGINT) AS profiles"""


def missing_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.examples(quality.missing_fields(table(spark, sf_dir, "candidate_profiles")), "field")


MISSING_EXAMPLES_SQL = f"""
WITH p AS (SELECT *, CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d FROM candidate_profiles),
m AS (
  SELECT 'name' AS field, source_filename FROM p WHERE coalesce(trim(name) = '', true) UNION SELECT 'email', source_filename FROM p WHERE coalesce(trim(email) = '', true) UNION SELECT 'phone', source_filename FROM p WHERE coalesce(trim(phone) = '', true)
  UNION SELECT 'skills', source_filename FROM p WHERE coalesce(len(skills), 0) = 0 UNION SELECT 'education', source_filename FROM p WHERE {_EMPTY('education')} = 1
  UNION SELECT 'experience', source_filename FROM p WHERE {_EMPTY('experience')} = 1 UNION SELECT 'projects', source_filename FROM p WHERE {_EMPTY('projects')} = 1)
SELECT source_filename, field, CAST(row_number() OVER (PARTITION BY field ORDER BY source_filename) AS INTEGER) AS example FROM m QUALIFY row_number() OVER (PARTITION BY field ORDER BY source_filename) <= 10"""


def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(quality.warnings(table(spark, sf_dir, "candidate_profiles")), "warning")


WARNINGS_SQL = """
WITH p AS (SELECT CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d FROM candidate_profiles)
SELECT warning, count(*) AS profiles FROM (SELECT json_extract_string(unnest(json_extract(json_extract(d, '$.metadata.warnings'), '$[*]')), '$') AS warning FROM p) WHERE warning IS NOT NULL GROUP BY 1"""


def warning_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.examples(quality.warnings(table(spark, sf_dir, "candidate_profiles")), "warning")


WARNING_EXAMPLES_SQL = """
WITH p AS (SELECT source_filename, CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d FROM candidate_profiles),
w AS (SELECT DISTINCT source_filename, json_extract_string(x, '$') AS warning FROM (SELECT source_filename, unnest(json_extract(json_extract(d, '$.metadata.warnings'), '$[*]')) AS x FROM p))
SELECT source_filename, warning, CAST(row_number() OVER (PARTITION BY warning ORDER BY source_filename) AS INTEGER) AS example FROM w WHERE warning IS NOT NULL QUALIFY row_number() OVER (PARTITION BY warning ORDER BY source_filename) <= 10"""


def queries() -> dict:
    own = [normalised_text, section_lines, section_texts, text_blocks, contacts, lexicon_counts, job_parts, skill_line_tokens, profile_parse, missing_fields, missing_examples, warning_counts, warning_examples]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "normalised_text": NORMALISED_SQL, "section_lines": _FILLED + "\nSELECT resume_id, section, count(*) AS lines, CAST(max(line_no) AS INTEGER) AS last_line FROM filled WHERE s IS NULL GROUP BY 1, 2", "section_texts": SECTION_TEXTS_SQL, "text_blocks": BLOCKS_SQL,
        "contacts": CONTACTS_SQL, "lexicon_counts": LEXICON_SQL, "job_parts": JOB_PARTS_SQL, "skill_line_tokens": SKILL_TOKENS_SQL, "missing_fields": MISSING_SQL, "missing_examples": MISSING_EXAMPLES_SQL, "warning_counts": WARNINGS_SQL, "warning_examples": WARNING_EXAMPLES_SQL,
    }
