"""Read queries of the service, as functions over tables. HTTP is left to whatever serves the frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import subtitle

RANKING = ("retrieval_rank", "ranking_rank", "semantic_similarity", "skill_coverage", "experience_alignment", "education_match", "role_relevance", "final_score", "score_breakdown")
PROFILE = ("name", "email", "phone", "skills", "education_count", "experience_count", "project_count", "warning_count")


def jobs(job_table: DataFrame) -> DataFrame:
    """All jobs by title, then id."""
    columns = ("job_id", "job_title", "location", "employment_type", "experience_required", "required_skills", "preferred_skills", "education")
    return job_table.select(*columns, subtitle(F.col("location"), F.col("employment_type"), F.col("experience_required")).alias("subtitle")).orderBy("job_title", "job_id")


def job(job_table: DataFrame, job_id: str) -> DataFrame:
    return job_table.where(F.col("job_id") == job_id)


def search_jobs(job_table: DataFrame, query: str) -> DataFrame:
    """Jobs whose title, location or id contains the words as typed, case ignored; all jobs for a blank query."""
    text = F.lower(F.concat_ws(" ", "job_title", "location", "job_id"))
    return job_table.where(text.contains(query.strip().lower())).orderBy("job_title", "job_id")


def rankings(ranking_table: DataFrame, profiles: DataFrame, job_id: str) -> DataFrame:
    """Ranked candidates of a job with their profile columns, by rank and id. The filter reaches the scan."""
    own = ranking_table.where(F.col("job_id") == job_id).select("job_id", "resume_id", *RANKING, F.col("created_at").alias("ranking_created_at"))
    return own.join(profiles.select("resume_id", *PROFILE), "resume_id").orderBy("ranking_rank", "resume_id")


def ranking_page(ranking_table: DataFrame, profiles: DataFrame, job_id: str, page: int = 0, size: int = 50) -> DataFrame:
    """One page of a job's ranking; the page is cut before the join, so only its rows look up their profile."""
    own = ranking_table.where(F.col("job_id") == job_id).orderBy("ranking_rank", "resume_id").offset(page * size).limit(size)
    return own.join(profiles.select("resume_id", *PROFILE), "resume_id", "left").orderBy("ranking_rank", "resume_id")


def ranking_detail(ranking_table: DataFrame, profiles: DataFrame, job_id: str, resume_id: str) -> DataFrame:
    """``ranking`` and ``candidate_profile`` of one pair as two structs; no rows for an unknown pair."""
    own = ranking_table.where((F.col("job_id") == job_id) & (F.col("resume_id") == resume_id)).withColumnRenamed("created_at", "ranking_created_at")
    one = own.join(profiles.select("resume_id", *PROFILE, "profile_json"), "resume_id")
    return one.select(F.struct("job_id", "resume_id", *RANKING, "ranking_created_at").alias("ranking"), F.struct("resume_id", *PROFILE, "profile_json").alias("candidate_profile"))


def job_retrievals(retrieval_table: DataFrame, job_id: str, top: int | None = None) -> DataFrame:
    """Stored retrievals of one job by rank, then id. The filter reaches the scan; an unknown job has no rows."""
    own = retrieval_table.where(F.col("job_id") == job_id).orderBy("retrieval_rank", "resume_id")
    return own if top is None else own.limit(top)


def existing(df: DataFrame, what: str) -> DataFrame:
    """``df`` if it has a row, else a KeyError: what a service answers as not found."""
    if df.isEmpty():
        raise KeyError(f"no such {what}")
    return df


def jobs_of_candidate(ranking_table: DataFrame, resume_id: str) -> DataFrame:
    return ranking_table.where(F.col("resume_id") == resume_id).select("job_id").distinct().orderBy("job_id")


def score_parts(ranking_table: DataFrame) -> DataFrame:
    """Breakdown of each ranked pair as one row for each named part."""
    return ranking_table.select("job_id", "resume_id", F.explode("score_breakdown").alias("part", "value"))
