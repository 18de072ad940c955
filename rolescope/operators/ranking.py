"""Scoring and ranking of retrieved candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents, lexicon, scoring
from ..functions.text import feature_form, token_set
from .positions import positions
from .versions import latest_rows


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Latest row of each job; rows without an id take no part."""
    return latest_rows(jobs.where("job_id is not null"), ["job_id"], "updated_at", [F.col("created_at").desc_nulls_last(), F.xxhash64("raw_text")])


def latest_candidates(profiles: DataFrame) -> DataFrame:
    """Latest row of each profile; rows without an id take no part."""
    return latest_rows(profiles.where("resume_id is not null"), ["resume_id"], "updated_at", [F.col("created_at").desc_nulls_last(), F.xxhash64("profile_json")])


def latest_retrievals(rankings: DataFrame) -> DataFrame:
    """``job_id``, ``resume_id``, ``retrieval_rank``, ``semantic_similarity`` of the latest row of each pair that has a
    similarity."""
    rows = rankings.select("job_id", "resume_id", "retrieval_rank", "semantic_similarity", "updated_at").where("job_id is not null and resume_id is not null")
    last = latest_rows(rows, ["job_id", "resume_id"], "updated_at", [F.col("semantic_similarity").desc_nulls_last(), F.col("retrieval_rank").asc_nulls_last()])
    return last.drop("updated_at").where("semantic_similarity is not null")


def candidate_features(profiles: DataFrame) -> DataFrame:
    """What scoring needs of each profile, computed once for each and not once for each pair."""
    parsed = profiles.withColumn("doc", documents.document(F.col("profile_json")))
    skills = F.filter(F.coalesce("skills", F.expr("cast(array() as array<string>)")), lambda s: s.isNotNull() & (s != ""))
    parsed = parsed.withColumn("text", scoring.candidate_feature_text(skills, F.col("doc")))
    parsed = parsed.withColumn("candidate_form", feature_form(F.coalesce("text", F.lit(""))))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return parsed.select(
        "resume_id", scoring.skill_forms(skills, drop_empty=True).alias("candidate_skills"), "candidate_form", token_set(F.col("candidate_form")).alias("candidate_tokens"),
        scoring.profile_years(F.col("doc")).alias("candidate_years"), scoring.profile_level(F.col("doc")).alias("candidate_level"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
        scoring.stored_or_counted(F.col("education_count"), documents.entries(F.col("doc"), "$.education")).alias("education_count"),
        scoring.stored_or_counted(F.col("experience_count"), documents.entries(F.col("doc"), "$.experience")).alias("experience_count"),
        scoring.stored_or_counted(F.col("project_count"), documents.entries(F.col("doc"), "$.projects")).alias("project_count"),
        F.size(skills).alias("skills_count"), filled("name").alias("has_name"), filled("email").alias("has_email"), filled("phone").alias("has_phone"),
    )


def job_features(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id", "job_title", scoring.skill_forms(F.col("required_skills")).alias("required_skills"), scoring.skill_forms(F.col("preferred_skills")).alias("preferred_skills"),
        "experience_required", F.col("education").alias("job_education"), scoring.title_tokens(F.col("job_title")).alias("title_tokens"),
    )


def signals(retrievals: DataFrame, jobs: DataFrame, profiles: DataFrame, match: str = "substring", weights: dict[str, float] = lexicon.WEIGHTS) -> DataFrame:
    """All signals of each retrieved pair whose job and profile exist: retrievals joined with jobs and profiles once.

    Pairs of unknown jobs or profiles are left out. Both joins are on ids and left to the optimiser, which broadcasts
    a small side and splits skewed jobs.
    """
    pairs = retrievals.join(job_features(jobs), "job_id").join(candidate_features(profiles), "resume_id")
    own = {
        "semantic_similarity": F.round("semantic_similarity", scoring.DIGITS),
        "skill_coverage": scoring.folded_coverage(F.col("required_skills"), F.col("preferred_skills"), F.col("candidate_skills"), F.col("candidate_form"), match),
        "experience_alignment": scoring.experience_alignment(F.col("experience_required"), F.col("candidate_years")),
        "education_match": scoring.education_match(F.col("job_education"), F.col("candidate_level")),
        "role_relevance": scoring.role_relevance(F.col("title_tokens"), F.col("candidate_tokens")),
    }
    flag = lambda c: F.col(c).cast("double").alias(c)
    scored = pairs.select(
        "job_id", "job_title", "resume_id", "retrieval_rank", *(c.alias(n) for n, c in own.items()), "warning_count",
        scoring.parser_quality(F.col("warning_count"), F.col("has_name"), F.col("has_email"), F.col("has_phone"), F.col("skills_count"), F.col("experience_count")).alias("parser_quality_score"),
        "education_count", "experience_count", "project_count", "skills_count", flag("has_name"), flag("has_email"), flag("has_phone"),
        F.size("required_skills").alias("required_skill_count"), F.size("preferred_skills").alias("preferred_skill_count"),
    )
    named = {n: F.col(n) for n in own}
    return scored.withColumn("final_score", scoring.final_score(named, weights)).withColumn("score_breakdown", scoring.breakdown(named))


def ranked(scored: DataFrame, top: int | None = None) -> DataFrame:
    """``ranking_rank`` of each pair within its job: by score, then retrieval rank, then id.

    The first ``top`` of each job are pruned before and after the shuffle; a complete ranking is numbered in ranges, so
    that no job is sorted in one task.
    """
    order = [F.col("final_score").desc_nulls_last(), F.col("retrieval_rank").asc_nulls_last(), F.col("resume_id").asc()]
    if top is None:
        return positions(scored, ["job_id"], order, "ranking_rank")
    return scored.withColumn("ranking_rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).where(F.col("ranking_rank") <= top)


def run_counters(ranking: DataFrame) -> DataFrame:
    """Jobs ranked and rows ranked."""
    return ranking.agg(F.countDistinct("job_id").alias("jobs_ranked"), F.count("*").alias("ranked_rows"))
