"""Queries that score, rank and retrieve candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, scoring, text
from ..operators import ranking, retrieval
from ..session import table

TEXT = "coalesce(text, '')"
_LATEST = """
WITH job AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v FROM job_descriptions WHERE job_id IS NOT NULL) WHERE v = 1
), prof AS (
  SELECT *, CASE WHEN json_type(profile_json) = 'VARCHAR' THEN json_extract_string(profile_json, '$') ELSE profile_json END AS d,
         list_filter(coalesce(skills, []), lambda s: s IS NOT NULL AND s <> '') AS sk
  FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v FROM candidate_profiles WHERE resume_id IS NOT NULL) WHERE v = 1
), ret AS (
  SELECT job_id, resume_id, retrieval_rank, semantic_similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY updated_at DESC NULLS LAST, semantic_similarity DESC NULLS LAST, retrieval_rank ASC NULLS LAST) AS v
    FROM job_candidate_rankings WHERE job_id IS NOT NULL AND resume_id IS NOT NULL) WHERE v = 1 AND semantic_similarity IS NOT NULL
)"""


def _items(path: str) -> str:
    return f"CASE json_type(d, '$.{path}') WHEN 'ARRAY' THEN json_extract(json_extract(d, '$.{path}'), '$[*]') WHEN 'NULL' THEN [] ELSE CASE WHEN json_type(d, '$.{path}') IS NULL THEN [] ELSE [json_extract(d, '$.{path}')] END END"


def _raw(path: str) -> str:
    return f"list_filter(list_transform({_items(path)}, lambda e: json_extract_string(e, '$.raw_text')), lambda t: t IS NOT NULL AND t <> '')"


def _form(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9+]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(string_split({_form(x)}, ' ')), lambda t: t NOT IN ('', 'a', 'an', 'and', 'engineer', 'for', 'in', 'of', 'or', 'the', 'to'))"


def _level(x: str) -> str:
    f = _form(f"coalesce({x}, '')")
    held = lambda words: " OR ".join(f"contains({f}, '{w}')" for w in words)
    return "CASE " + " ".join(f"WHEN {held(words)} THEN {level}" for level, words in scoring.LEVELS) + " ELSE 0 END"


_FEATURES = _LATEST + f""", feat AS (
  SELECT resume_id, sk, concat_ws(chr(10), nullif(array_to_string(sk, ', '), ''), nullif(array_to_string({_raw('experience')}, chr(10)), ''), nullif(array_to_string({_raw('projects')}, chr(10)), ''),
         nullif(array_to_string({_raw('education')}, chr(10)), ''), nullif(json_extract_string(d, '$.raw_text'), '')) AS txt,
         list_filter(list_transform(list_filter({_items('experience')}, lambda e: json_type(e) <> 'NULL'),
           lambda e: lower(coalesce(nullif(json_extract_string(e, '$.date_range'), ''), json_extract_string(e, '$.raw_text'), ''))), lambda t: true) AS dates,
         coalesce(list_max(list_transform({_raw('education')}, lambda t: {_level('t')})), 0) AS lvl
  FROM prof
), worked AS (
  SELECT *, list_transform(list_filter(dates, lambda t: len(regexp_extract_all(t, '(?:19|20)[0-9]{{2}}')) > 0),
         lambda t: CAST(greatest(list_max(list_transform(regexp_extract_all(t, '(?:19|20)[0-9]{{2}}'), lambda y: CAST(y AS INTEGER)))
         - list_min(list_transform(regexp_extract_all(t, '(?:19|20)[0-9]{{2}}'), lambda y: CAST(y AS INTEGER))), 1) AS DOUBLE)) AS spans
  FROM feat
), cand AS (
  SELECT *, {_form("coalesce(txt, '')")} AS ftxt, list_transform(sk, lambda s: {_form('s')}) AS fsk, {_tokens("coalesce(txt, '')")} AS tok,
         CASE WHEN len(spans) > 0 THEN least(list_sum(spans), 20.0) ELSE CAST(len(dates) AS DOUBLE) END AS years
  FROM worked
), jobf AS (
  SELECT job_id, job_title, experience_required, education, list_filter(coalesce(required_skills, []), lambda s: s IS NOT NULL) AS req, list_filter(coalesce(preferred_skills, []), lambda s: s IS NOT NULL) AS pref,
         {_tokens("coalesce(job_title, '')")} AS title_tok,
         coalesce(CAST(nullif(regexp_extract(experience_required, '(?i)([0-9]+)\\s*-\\s*([0-9]+)\\s*years?', 1), '') AS INTEGER), CAST(nullif(regexp_extract(experience_required, '(?i)([0-9]+)\\+\\s*years?', 1), '') AS INTEGER)) AS least_years,
         {_level('education')} AS job_lvl
  FROM job
), held AS (
  SELECT r.job_id, r.resume_id, r.retrieval_rank, round(r.semantic_similarity, 6) AS semantic_similarity, c.years, c.lvl, c.tok, j.*  EXCLUDE (job_id),
         len(list_filter(j.req, lambda s: list_contains(c.fsk, {_form('s')}) OR contains(c.ftxt, {_form('s')}))) AS nr,
         len(list_filter(j.pref, lambda s: list_contains(c.fsk, {_form('s')}) OR contains(c.ftxt, {_form('s')}))) AS np
  FROM ret r JOIN jobf j ON r.job_id = j.job_id JOIN cand c ON r.resume_id = c.resume_id
), sig AS (
  SELECT job_id, resume_id, retrieval_rank, semantic_similarity,
         round(CASE WHEN len(req) > 0 AND len(pref) > 0 THEN 0.7::DOUBLE * (nr::DOUBLE / len(req)) + 0.3::DOUBLE * (np::DOUBLE / len(pref)) WHEN len(req) > 0 THEN nr::DOUBLE / len(req) WHEN len(pref) > 0 THEN np::DOUBLE / len(pref) ELSE 0.5 END, 6) AS skill_coverage,
         CASE WHEN least_years IS NULL THEN 0.5 WHEN years <= 0 THEN 0.0 ELSE round(least(years / greatest(least_years, 1), 1.0), 6) END AS experience_alignment,
         CASE WHEN job_lvl > 0 AND lvl >= job_lvl THEN 1.0 WHEN lvl > 0 THEN 0.5 ELSE 0.0 END AS education_match,
         CASE WHEN len(title_tok) > 0 THEN round(len(list_intersect(title_tok, tok))::DOUBLE / len(title_tok), 6) ELSE 0.0 END AS role_relevance
  FROM held
), scored AS (
  SELECT *, CAST(round(CAST(0.45::DOUBLE * semantic_similarity + 0.25::DOUBLE * skill_coverage + 0.15::DOUBLE * experience_alignment + 0.1::DOUBLE * education_match + 0.05::DOUBLE * role_relevance AS DECIMAL(18, 9)), 6) AS DOUBLE) AS final_score FROM sig
)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.signals(
        ranking.latest_retrievals(table(spark, sf_dir, "job_candidate_rankings")), ranking.latest_jobs(table(spark, sf_dir, "job_descriptions")), ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))
    )


_SIGNAL_COLUMNS = ("job_id", "resume_id", "retrieval_rank", "semantic_similarity", "skill_coverage", "experience_alignment", "education_match", "role_relevance", "final_score")


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and score of every retrieved pair."""
    return _signals(spark, sf_dir).select(*_SIGNAL_COLUMNS)


def breakdown_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each named signal in the breakdowns of all retrieved pairs."""
    parts = _signals(spark, sf_dir).select(F.explode("score_breakdown").alias("part", "value"))
    return parts.groupBy("part").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


BREAKDOWN_SQL = _FEATURES + "\nSELECT part, count(value) AS n, round(avg(value), 4) AS mean FROM (UNPIVOT (SELECT semantic_similarity, skill_coverage, experience_alignment, education_match, role_relevance FROM scored) ON COLUMNS(*) INTO NAME part VALUE value) GROUP BY part"


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of each job by score."""
    return ranking.ranked(_signals(spark, sf_dir), 10).select(*_SIGNAL_COLUMNS, "ranking_rank")


SHORTLIST_SQL = _FEATURES + f"""
SELECT * FROM (SELECT {', '.join(_SIGNAL_COLUMNS)}, CAST(row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, retrieval_rank ASC NULLS LAST, resume_id) AS INTEGER) AS ranking_rank FROM scored) WHERE ranking_rank <= 10"""


def ranking_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.run_counters(ranking.ranked(_signals(spark, sf_dir)))


def candidate_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))
    doc = documents.document(F.col("profile_json"))
    return profiles.select("resume_id", scoring.profile_years(doc).alias("years"), scoring.profile_level(doc).alias("level"))


def required_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, most = scoring.required_years(F.col("experience_required"))
    return table(spark, sf_dir, "job_descriptions").select("experience_required", least.alias("least_years"), most.alias("most_years")).distinct()


REQUIRED_SQL = r"""
SELECT DISTINCT experience_required,
  coalesce(CAST(nullif(regexp_extract(experience_required, '(?i)([0-9]+)\s*-\s*([0-9]+)\s*years?', 1), '') AS INTEGER), CAST(nullif(regexp_extract(experience_required, '(?i)([0-9]+)\+\s*years?', 1), '') AS INTEGER)) AS least_years,
  CAST(nullif(regexp_extract(experience_required, '(?i)([0-9]+)\s*-\s*([0-9]+)\s*years?', 2), '') AS INTEGER) AS most_years
FROM job_descriptions"""


def education_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "job_descriptions")
    return jobs.groupBy("education").agg(F.count("*").alias("jobs")).withColumn("level", scoring.education_level(F.col("education")))


def parser_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    skills = F.size(F.filter(F.coalesce("skills", F.expr("cast(array() as array<string>)")), lambda s: s.isNotNull() & (s != "")))
    score = scoring.parser_quality(F.col("warning_count"), filled("name"), filled("email"), filled("phone"), skills, F.col("experience_count"))
    return p.select("resume_id", score.alias("quality"))


QUALITY_SQL = _LATEST + """
SELECT resume_id, round(greatest(1.0::DOUBLE - least(greatest(coalesce(warning_count, 0), 0), 5) * 0.08::DOUBLE - CASE WHEN coalesce(trim(name) <> '', false) THEN 0.0 ELSE 0.15 END::DOUBLE
  - CASE WHEN coalesce(trim(email) <> '', false) THEN 0.0 ELSE 0.10 END::DOUBLE - CASE WHEN coalesce(trim(phone) <> '', false) THEN 0.0 ELSE 0.05 END::DOUBLE
  - CASE WHEN len(list_filter(coalesce(skills, []), lambda s: s IS NOT NULL AND s <> '')) = 0 THEN 0.10 ELSE 0.0 END::DOUBLE - CASE WHEN coalesce(experience_count, 0) = 0 THEN 0.05 ELSE 0.0 END::DOUBLE, 0.0), 6) AS quality
FROM prof"""


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the text that stands for each latest profile in an encoder."""
    p = ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))
    own = scoring.candidate_embedding_text(F.col("name"), F.filter(F.col("skills"), lambda s: s.isNotNull()), documents.document(F.col("profile_json")))
    return p.select("resume_id", F.sha2(own, 256).alias("content_sha256"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 rows nearest to each row whose id is divisible by 100, over all rows."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.top_k(queries, e, "query_id", "vec_id", "embedding", 25)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "retrieval_rank")


_VECTOR = """
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id, round((round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 10) + 1) / 2, 9) AS sim
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM s)"""
VECTOR_SQL = _VECTOR + "\nSELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(k AS INTEGER) AS retrieval_rank FROM r WHERE k <= 25"


def _topk_change(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored lists of ten, and new similarities: every row of label 0 gets half its similarity to each query."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.top_k(queries, e, "query_id", "vec_id", "embedding", 25).select(F.col("query_id").alias("job_id"), F.col("vec_id").alias("resume_id"), F.round("similarity", 6).alias("similarity"), "retrieval_rank")
    new = found.join(e.where("label = 0").select(F.col("vec_id").alias("resume_id")), "resume_id").select("job_id", "resume_id", (F.col("similarity") / 2).alias("similarity"))
    return found.where("retrieval_rank <= 10").select("job_id", "resume_id", "similarity"), new


def topk_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lists after the change, only stored and new rows competing."""
    stored, new = _topk_change(spark, sf_dir)
    out = retrieval.merged_top_k(stored, new, 10)
    return out.select("job_id", "resume_id", F.round("similarity", 9).alias("similarity"), "retrieval_rank", "changed")


TOPK_DELTA_SQL = _VECTOR + """
, f AS (SELECT query_id AS job_id, vec_id AS resume_id, round(sim, 6) AS similarity, k FROM r WHERE k <= 25),
n AS (SELECT job_id, resume_id, round(similarity / 2, 12) AS similarity FROM f JOIN embeddings e ON e.vec_id = f.resume_id WHERE e.label = 0),
o AS (SELECT job_id, resume_id, similarity FROM f WHERE k <= 10),
u AS (SELECT o.job_id, o.resume_id, o.similarity, false AS is_new FROM o ANTI JOIN n ON n.job_id = o.job_id AND n.resume_id = o.resume_id UNION ALL SELECT job_id, resume_id, similarity, true FROM n),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, resume_id) AS k FROM u) WHERE k <= 10),
t AS (SELECT DISTINCT job_id FROM b WHERE is_new UNION SELECT DISTINCT o.job_id FROM o SEMI JOIN n ON n.job_id = o.job_id AND n.resume_id = o.resume_id)
SELECT job_id, resume_id, round(similarity, 9) AS similarity, CAST(k AS INTEGER) AS retrieval_rank, true AS changed FROM b SEMI JOIN t ON t.job_id = b.job_id
UNION ALL
SELECT job_id, resume_id, round(similarity, 9), CAST(row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, resume_id) AS INTEGER), false FROM o ANTI JOIN t ON t.job_id = o.job_id"""


def hashed_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and norm of the hashed vector of each job's title and skills, its places that are not zero, and a weighted sum."""
    jobs = ranking.latest_jobs(table(spark, sf_dir, "job_descriptions"))
    own = scoring.job_embedding_text(F.col("job_title"), F.lit(None), F.lit(None).cast("array<string>"), F.col("required_skills"), F.col("preferred_skills"), F.col("education"), F.lit(None).cast("array<string>"))
    v = retrieval.hashed_vectors(jobs.select("job_id", own.alias("t")), "job_id", "t")
    placed = F.transform("embedding", lambda x, i: x * (i + 1))
    return v.select(
        "job_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"), F.round(F.aggregate(placed, F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"),
    )


HASHED_SQL = _LATEST + r""",
t AS (SELECT job_id, lower(concat_ws(chr(10), 'Job Title: ' || coalesce(job_title, ''), 'Required Skills: ' || nullif(array_to_string(list_filter(required_skills, lambda s: s IS NOT NULL), ', '), ''),
  'Preferred Skills: ' || nullif(array_to_string(list_filter(preferred_skills, lambda s: s IS NOT NULL), ', '), ''), 'Education: ' || nullif(education, ''))) AS t FROM job),
w AS (SELECT job_id, md5(w) AS h FROM (SELECT job_id, unnest(string_split_regex(t, '[^\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS w FROM t) WHERE w <> ''),
s AS (SELECT job_id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS INTEGER) AS slot, sum(CASE WHEN substr(h, 9, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM w GROUP BY 1, 2),
n AS (SELECT job_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1)
SELECT job.job_id, 256 AS dim, CASE WHEN coalesce(any_value(n.norm), 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, CAST(count(*) FILTER (s.x <> 0) AS INTEGER) AS filled, round(coalesce(sum(s.x / n.norm * (slot + 1)), 0.0), 4) AS weighted
FROM job LEFT JOIN s ON s.job_id = job.job_id LEFT JOIN n ON n.job_id = job.job_id GROUP BY job.job_id"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(scoring.split_bucket(F.col("o_orderkey").cast("string")).alias("split")).agg(F.count("*").alias("orders"))


SPLIT_SQL = """
WITH b AS (SELECT (16 * (strpos('0123456789abcdef', substr(h, 1, 1)) - 1) + strpos('0123456789abcdef', substr(h, 2, 1)) - 1) / 255.0 AS share FROM (SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS h FROM orders))
SELECT CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS orders FROM b GROUP BY 1"""


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.token_set(F.col("text"))).alias("tokens"))


def queries() -> dict:
    own = [shortlist, breakdown_means, signal_table, ranking_counters, candidate_years, required_experience, education_levels, parser_quality, embedding_texts, vector_topk, topk_delta, hashed_encoder, splits, token_sets]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "shortlist": SHORTLIST_SQL, "breakdown_means": BREAKDOWN_SQL, "signal_table": _FEATURES + f"\nSELECT {', '.join(_SIGNAL_COLUMNS)} FROM scored", "ranking_counters": _FEATURES + "\nSELECT count(DISTINCT job_id) AS jobs_ranked, count(*) AS ranked_rows FROM scored",
        "candidate_years": _FEATURES + "\nSELECT resume_id, years, lvl AS level FROM cand", "required_experience": REQUIRED_SQL,
        "education_levels": f"SELECT education, count(*) AS jobs, {_level('education')} AS level FROM job_descriptions GROUP BY education", "parser_quality": QUALITY_SQL,
        "embedding_texts": _LATEST + f""", parts AS (SELECT resume_id, d, concat_ws(chr(10), 'Candidate: ' || nullif(name, ''), 'Skills: ' || nullif(array_to_string(list_filter(skills, lambda s: s IS NOT NULL), ', '), ''), 'Experience: ' || nullif(array_to_string({_raw('experience')}, ' '), ''),
          'Projects: ' || nullif(array_to_string({_raw('projects')}, ' '), ''), 'Education: ' || nullif(array_to_string({_raw('education')}, ' '), ''), 'Achievements: ' || nullif(json_extract_string(d, '$.sections.achievements'), '')) AS t FROM prof)
          SELECT resume_id, sha256(trim(coalesce(nullif(t, ''), json_extract_string(d, '$.raw_text'), ''))) AS content_sha256 FROM parts""",
        "vector_topk": VECTOR_SQL, "topk_delta": TOPK_DELTA_SQL, "hashed_encoder": HASHED_SQL, "splits": SPLIT_SQL,
        "token_sets": f"SELECT doc_id, len({_tokens(TEXT)}) AS tokens FROM documents",
    }
