"""Registered queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import corpus_encoding, eval_leakage, group_topn, label_overlap, name_linking, pii, rank_fusion, reading_level, skill_mapping

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_overlap.overlapping_labels(table(spark, sf_dir, "relevance_labels"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_overlap.overlap_report(table(spark, sf_dir, "relevance_labels"))


def p1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_overlap.key_overlaps(table(spark, sf_dir, "relevance_labels"))


def _mapped_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill_mapping.mapped_skills(
        table(spark, sf_dir, "job_descriptions"), table(spark, sf_dir, "candidate_profiles"), table(spark, sf_dir, "skill_catalog")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped_skills(spark, sf_dir)


def p2_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = skill_mapping.typed_values(table(spark, sf_dir, "job_descriptions"), table(spark, sf_dir, "candidate_profiles"))
    return skill_mapping.map_mentions(values, table(spark, sf_dir, "skill_catalog"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill_mapping.unmatched_report(_mapped_skills(spark, sf_dir))


def p2_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill_mapping.usage_report(_mapped_skills(spark, sf_dir), table(spark, sf_dir, "skill_catalog"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_spans(table(spark, sf_dir, "candidate_profiles"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted_texts(table(spark, sf_dir, "candidate_profiles"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(pii.found_spans(table(spark, sf_dir, "candidate_profiles")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_fusion.joint_ranking(table(spark, sf_dir, "job_candidate_rankings"), table(spark, sf_dir, "fusion_jobs"))
    return found.select("job_id", "resume_id")


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole joint ranking of every job."""
    rankings = table(spark, sf_dir, "job_candidate_rankings")
    fused = rank_fusion.joint_ranking(rankings, None, None)
    return fused.select("job_id", "resume_id", F.round("fused", 9).alias("fused"), "pos")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_linking.link_applicants(
        table(spark, sf_dir, "candidate_profiles"), table(spark, sf_dir, "resume_files"), table(spark, sf_dir, "nicknames")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_linking.linked_pairs(_people(spark, sf_dir))


def p6_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each named record with its person and the number of records linked to it."""
    people = _people(spark, sf_dir)
    sizes = people.groupBy("person").agg((F.count("*") - 1).alias("links"))
    return people.join(sizes, "person").select("id", "scope", "person", "links")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_topn.best_candidates(table(spark, sf_dir, "job_candidate_rankings"))


P7_SQL = """
WITH last AS (
  SELECT job_id, resume_id, final_score, retrieval_rank,
         row_number() OVER (PARTITION BY job_id, resume_id
                            ORDER BY updated_at DESC NULLS LAST, final_score DESC NULLS LAST, retrieval_rank ASC NULLS LAST) AS v
  FROM job_candidate_rankings
), ranked AS (
  SELECT job_id, resume_id, row_number() OVER (PARTITION BY job_id
         ORDER BY final_score DESC, retrieval_rank ASC NULLS LAST, resume_id ASC) AS pos
  FROM last WHERE v = 1 AND final_score IS NOT NULL AND NOT isnan(final_score)
)
SELECT job_id, resume_id, CAST(pos AS INTEGER) AS pos FROM ranked WHERE pos <= 10
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_encoding.encode(table(spark, sf_dir, "documents"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return corpus_encoding.token_profile(corpus_encoding.encode(documents), documents)


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_encoding.round_trip(table(spark, sf_dir, "documents"))


P8_ROUND_TRIP_SQL = "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS changed FROM documents"


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eval_leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leakage.leaked_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.bands_of_english(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_anchors"))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.band_profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_anchors"))


def queries() -> dict[str, Query]:
    own = [p1_found, p1_report, p1_keys, p2_found, p2_mentions, p2_unmatched, p2_usage, p3_found, p3_redacted, p3_report, p5_found, p5_ranking, p6_found, p6_people, p7_found, p8_ids, p8_profile, p8_round_trip, p9_found, p9_report, p10_found, p10_profile]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL, "p8_round_trip": P8_ROUND_TRIP_SQL}
