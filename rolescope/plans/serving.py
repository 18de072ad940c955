"""Queries of the read service and of the table store, over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranking
from ..operators.versions import latest_rows
from ..session import checkpoint_root, table
from ..sources import store
from . import serve

_JOB = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v FROM job_descriptions WHERE job_id IS NOT NULL) WHERE v = 1"
_RANK = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY updated_at DESC NULLS LAST, final_score DESC NULLS LAST, retrieval_rank ASC NULLS LAST, cardinality(score_breakdown) DESC NULLS LAST, created_at) AS v FROM job_candidate_rankings) WHERE v = 1"""
_PROF = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS v FROM candidate_profiles WHERE resume_id IS NOT NULL) WHERE v = 1"
#: The job that the service's examples ask for: the one with most ranked candidates is a hot key on purpose.
JOB = "quarry_surveyor_jd_00000001"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    jobs = ranking.latest_jobs(table(spark, sf_dir, "job_descriptions"))
    ranked = latest_rows(table(spark, sf_dir, "job_candidate_rankings"), ["job_id", "resume_id"], "updated_at", [F.col("final_score").desc_nulls_last(), F.col("retrieval_rank").asc_nulls_last(), F.size("score_breakdown").desc(), F.col("created_at")])
    return jobs, ranked, ranking.latest_candidates(table(spark, sf_dir, "candidate_profiles"))


def api_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.jobs(_tables(spark, sf_dir)[0]).select("job_id", "job_title", "location", "subtitle")


def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.search_jobs(_tables(spark, sf_dir)[0], " Engineer").select("job_id", "job_title")


def api_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ranked, profiles = _tables(spark, sf_dir)
    out = serve.rankings(ranked, profiles, JOB)
    return out.select("job_id", "resume_id", "ranking_rank", "final_score", "name", text.percent_label(F.col("skill_coverage")).alias("coverage"), text.tier(F.col("final_score")).alias("tier"), text.initials(F.col("name"), F.col("resume_id")).alias("initials"))


API_RANKINGS_SQL = f"""
SELECT r.job_id, r.resume_id, r.ranking_rank, r.final_score, p.name, printf('%.1f%%', round(coalesce(r.skill_coverage, 0) * 100, 1)) AS coverage, CASE WHEN coalesce(r.final_score, 0) >= 0.75 THEN 'high' WHEN coalesce(r.final_score, 0) >= 0.5 THEN 'mid' ELSE 'low' END AS tier,
  upper(CASE WHEN len(w) = 1 THEN substr(w[1], 1, 2) ELSE substr(w[1], 1, 1) || substr(w[-1], 1, 1) END) AS initials
FROM ({_RANK}) r JOIN (SELECT *, string_split_regex(regexp_replace(coalesce(nullif(name, ''), resume_id), '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM ({_PROF})) p ON p.resume_id = r.resume_id WHERE r.job_id = '{JOB}'"""


def api_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of fifty."""
    _, ranked, profiles = _tables(spark, sf_dir)
    return serve.ranking_page(ranked, profiles, JOB, 1, 50).select("resume_id", "ranking_rank", "name")


API_PAGE_SQL = f"SELECT r.resume_id, r.ranking_rank, p.name FROM (SELECT * FROM ({_RANK}) WHERE job_id = '{JOB}' ORDER BY ranking_rank NULLS FIRST, resume_id LIMIT 50 OFFSET 50) r LEFT JOIN ({_PROF}) p ON p.resume_id = r.resume_id"


def api_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the best stored pair of the job, read by its two keys."""
    _, ranked, profiles = _tables(spark, sf_dir)
    best = ranked.where((F.col("job_id") == JOB) & F.col("ranking_rank").isNotNull()).orderBy("ranking_rank", "resume_id").select("resume_id").first()
    one = serve.ranking_detail(ranked, profiles, JOB, best.resume_id if best else "")
    return one.select("ranking.job_id", "ranking.resume_id", "ranking.final_score", "candidate_profile.name", "candidate_profile.experience_count")


API_DETAIL_SQL = f"""
WITH r AS ({_RANK}), b AS (SELECT * FROM r WHERE job_id = '{JOB}' AND ranking_rank IS NOT NULL ORDER BY ranking_rank, resume_id LIMIT 1)
SELECT b.job_id, b.resume_id, b.final_score, p.name, p.experience_count FROM b JOIN ({_PROF}) p ON p.resume_id = b.resume_id"""


def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each named part of the stored breakdowns."""
    parts = serve.score_parts(_tables(spark, sf_dir)[1])
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.round("value", 6)), 3).alias("mean"))


PARTS_SQL = f"SELECT part, count(*) AS n, round(avg(round(value, 6)), 3) AS mean FROM (SELECT e.key AS part, e.value AS value FROM (SELECT unnest(map_entries(score_breakdown)) AS e FROM ({_RANK}))) GROUP BY 1"


def jobs_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs list each candidate."""
    return _tables(spark, sf_dir)[1].groupBy("resume_id").agg(F.countDistinct("job_id").alias("jobs"))


def upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged into a table in two batches by user: the last event of a batch holds, the first batch's time stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    middle = e.agg(F.expr("max(event_id) div 2")).first()[0] or 0
    stamp = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    first = store.merged(None, e.where(F.col("event_id") <= middle), ["user_id"], stamp(1), [F.col("event_id").desc()])
    both = store.merged(first, e.where(F.col("event_id") > middle), ["user_id"], stamp(2), [F.col("event_id").desc()])
    return both.select("user_id", "event_id", "value", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


UPSERT_SQL = """
WITH m AS (SELECT max(event_id) // 2 AS mid FROM events), b AS (SELECT *, CASE WHEN event_id <= mid THEN 1 ELSE 2 END AS batch FROM events, m)
SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value, '2024-01-0' || min(batch) AS created, '2024-01-0' || max(batch) AS updated FROM b WHERE user_id IS NOT NULL GROUP BY 1"""


def replaced_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table of rankings in which the rows of one job are replaced by its first ten."""
    _, ranked, _ = _tables(spark, sf_dir)
    import uuid

    t = store.Table(spark, f"{checkpoint_root(spark)}/store", f"rankings_{uuid.uuid4().hex}", key=("job_id",))
    t.replace(ranked.select("job_id", "resume_id", "ranking_rank"))
    t.replace_groups(t.read().where((F.col("job_id") == JOB) & (F.col("ranking_rank") <= 10)), "job_id")
    return t.read().groupBy("job_id").agg(F.count("*").alias("rows"))


REPLACED_SQL = f"SELECT job_id, count(*) AS rows FROM ({_RANK}) WHERE job_id <> '{JOB}' OR ranking_rank <= 10 GROUP BY 1"


def not_yet_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the audit without a profile of their stem, one for each stem."""
    files = store.first_of_stem(table(spark, sf_dir, "resume_files").select(F.col("relative_path").alias("path")).distinct())
    written = table(spark, sf_dir, "candidate_profiles").select(text.stem(F.col("source_filename")).alias("stem"))
    return store.not_yet_written(files.withColumn("stem", text.stem(F.col("path"))), written, "stem").select("stem", "path")


NOT_YET_SQL = r"""
WITH f AS (SELECT DISTINCT relative_path AS path, regexp_replace(string_split(relative_path, '/')[-1], '(.)\.[^.]*$', '\1') AS stem FROM resume_files WHERE relative_path IS NOT NULL),
o AS (SELECT stem, min(path) AS path FROM f GROUP BY 1)
SELECT stem, path FROM o ANTI JOIN (SELECT DISTINCT regexp_replace(source_filename, '(.)\.[^.]*$', '\1') AS s FROM candidate_profiles) p ON p.s = o.stem"""


def orphan_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked pairs left once those without a profile are gone, by job."""
    _, ranked, profiles = _tables(spark, sf_dir)
    return store.without_parent(ranked, profiles, "resume_id").groupBy("job_id").agg(F.count("*").alias("rows"))


ORPHANS_SQL = f"SELECT job_id, count(*) AS rows FROM ({_RANK}) r SEMI JOIN candidate_profiles p ON p.resume_id = r.resume_id GROUP BY 1"


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON payloads read by path, counted by type."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"))


PAYLOADS_SQL = "SELECT event_type, count(*) AS events, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile table read as a stream and merged batch by batch: rows of each folder in the end."""
    import uuid

    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    own = store.opened(spark, root, "profiles")
    source = table(spark, sf_dir, "candidate_profiles")

    def batch(df: DataFrame, _: int) -> None:
        new = df.select("resume_id", "source_path", F.col("updated_at").alias("row_time"))
        if own.exists():  # a late batch may hold older rows
            new = new.unionByName(own.read().select("resume_id", "source_path", "row_time"))
        own.merge(new, ["resume_id"], order=[F.col("row_time").desc_nulls_last(), F.col("source_path")])

    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/candidate_profiles.parque[t]")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return own.read().groupBy(F.element_at(F.split("source_path", "/"), -2).alias("folder")).agg(F.count("*").alias("profiles"))


STREAM_SQL = f"SELECT string_split(source_path, '/')[-2] AS folder, count(*) AS profiles FROM ({_PROF}) GROUP BY 1"


def job_retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored retrievals of one job, the first 25 by rank."""
    own = table(spark, sf_dir, "job_candidate_rankings").where("retrieval_rank is not null")
    return serve.job_retrievals(own.select("job_id", "resume_id", "retrieval_rank").distinct(), JOB, 25)


RETRIEVALS_SQL = f"SELECT * FROM (SELECT DISTINCT job_id, resume_id, retrieval_rank FROM job_candidate_rankings WHERE job_id = '{JOB}' AND retrieval_rank IS NOT NULL) ORDER BY retrieval_rank, resume_id LIMIT 25"


def queries() -> dict:
    own = [job_retrievals, api_jobs, job_search, api_rankings, api_page, api_detail, score_parts, jobs_of_candidates, upsert_events, replaced_rankings, not_yet_parsed, orphan_rankings, event_payloads, stream_upserts]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "job_retrievals": RETRIEVALS_SQL, "api_jobs": f"SELECT job_id, job_title, location, concat_ws(' • ', nullif(location, ''), nullif(employment_type, ''), nullif(experience_required, '')) AS subtitle FROM ({_JOB})",
        "job_search": f"SELECT job_id, job_title FROM ({_JOB}) WHERE contains(lower(concat_ws(' ', job_title, location, job_id)), 'engineer')", "api_rankings": API_RANKINGS_SQL, "api_page": API_PAGE_SQL, "api_detail": API_DETAIL_SQL, "score_parts": PARTS_SQL,
        "jobs_of_candidates": f"SELECT resume_id, count(DISTINCT job_id) AS jobs FROM ({_RANK}) GROUP BY 1", "upsert_events": UPSERT_SQL, "replaced_rankings": REPLACED_SQL, "not_yet_parsed": NOT_YET_SQL, "orphan_rankings": ORPHANS_SQL, "event_payloads": PAYLOADS_SQL, "stream_upserts": STREAM_SQL,
    }
