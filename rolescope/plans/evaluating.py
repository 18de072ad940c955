"""Queries of the offline evaluation, over relevance labels and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, learning, ranking
from ..operators.versions import latest_rows
from ..session import cut, table
from .shortlist import _FEATURES, _LATEST, QUALITY_SQL, _signals


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.clean_labels(table(spark, sf_dir, "relevance_labels"), strict=False)


def _one_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each pair: of repeated ones the highest grade."""
    rows = _labels(spark, sf_dir)
    return latest_rows(rows, ["job_id", "resume_id"], "label", [F.col(c).asc_nulls_last() for c in ("split", "source", "notes")])


_CLEAN = r"""
WITH lab AS (SELECT trim(job_id, chr(32) || chr(9) || chr(10) || chr(13)) AS job_id, trim(resume_id, chr(32) || chr(9) || chr(10) || chr(13)) AS resume_id, label,
  CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'validation' WHEN 'valid' THEN 'validation' WHEN 'validation' THEN 'validation' WHEN 'test' THEN 'test' END AS split, nullif(trim(source), '') AS source
  FROM relevance_labels WHERE label >= 0)"""


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.label_counts(_labels(spark, sf_dir))


LABEL_COUNTS_SQL = _CLEAN + "\nSELECT coalesce(split, 'unspecified') AS split, label, count(*) AS labels, count(DISTINCT job_id) AS jobs FROM lab GROUP BY 1, 2"


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.label_summary(_labels(spark, sf_dir))
    return s.select("label_count", "job_count", "resume_count", F.col("split_counts")["train"].alias("train"), F.col("label_counts")["3"].alias("grade_3"))


LABEL_SUMMARY_SQL = _CLEAN + "\nSELECT count(*) AS label_count, count(DISTINCT job_id) AS job_count, count(DISTINCT resume_id) AS resume_count, count(*) FILTER (split = 'train') AS train, count(*) FILTER (label = 3) AS grade_3 FROM lab"


def duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.duplicate_keys(_labels(spark, sf_dir), ["job_id", "resume_id"])


DUPLICATES_SQL = _CLEAN + "\nSELECT job_id, resume_id, count(*) AS rows FROM lab GROUP BY 1, 2 HAVING count(*) > 1"


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graded pairs: the user is the job, the value the score, the id's remainder by four the grade."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), F.format_string("%012d", "event_id").alias("resume_id"), (F.col("event_id") % 4).cast("int").alias("label"), (F.col("event_id") % 7).cast("int").alias("retrieval_rank"),
        F.col("value").alias("heuristic_score"), (-F.col("value")).alias("adjusted_score"),
    )


_EVENTS = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, printf('%012d', event_id) AS resume_id, CAST(event_id % 4 AS INTEGER) AS label, event_id % 7 AS rr, value FROM events),
u AS (SELECT *, 'heuristic_score' AS score_field, value AS score FROM e UNION ALL SELECT *, 'adjusted_score', -value FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY score_field, job_id ORDER BY score DESC, CASE WHEN rr = 0 THEN 1000000000 ELSE rr END, resume_id) AS pos, row_number() OVER (PARTITION BY score_field, job_id ORDER BY label DESC) AS ideal FROM u WHERE score IS NOT NULL),
m AS (SELECT score_field, job_id, count(*) AS n, sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END) AS rel, sum(CASE WHEN label >= 1 AND pos <= 5 THEN 1 ELSE 0 END) AS ph, sum(CASE WHEN label >= 1 AND pos <= 10 THEN 1 ELSE 0 END) AS rh,
  coalesce(sum(CASE WHEN pos <= 10 THEN (power(2, label) - 1) / log2(pos + 1) END), 0) AS dcg, coalesce(sum(CASE WHEN ideal <= 10 THEN (power(2, label) - 1) / log2(ideal + 1) END), 0) AS idcg FROM k GROUP BY 1, 2),
j AS (SELECT score_field, job_id, n, rel, round(ph::DOUBLE / least(5, n), 6) AS p, CASE WHEN rel > 0 THEN round(rh::DOUBLE / rel, 6) ELSE 0.0 END AS r, CASE WHEN idcg > 0 THEN round(dcg / idcg, 6) ELSE 0.0 END AS g FROM m)"""


def metrics_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and NDCG of each job and score field."""
    return evaluation.job_metrics(evaluation.by_score_field(_event_rows(spark, sf_dir), ["heuristic_score", "adjusted_score"]))


METRICS_SQL = _EVENTS + "\nSELECT score_field, job_id, n AS labeled_pair_count, CAST(rel AS BIGINT) AS relevant_pair_count, p AS precision_at_k, r AS recall_at_k, g AS ndcg_at_k FROM j"


def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_metrics(metrics_by_job(spark, sf_dir))


_MEAN = """
SELECT score_field, count(*) AS jobs_with_labels, CAST(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS BIGINT) AS jobs_with_relevant_labels, CAST(sum(n) AS BIGINT) AS labeled_pair_count,
  CAST(round(CAST(sum(CAST(p AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS DOUBLE) AS precision_at_k, CAST(round(CAST(sum(CAST(r AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS DOUBLE) AS recall_at_k, CAST(round(CAST(sum(CAST(g AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS DOUBLE) AS ndcg_at_k FROM j GROUP BY 1"""
MEAN_SQL = _EVENTS + _MEAN


def _ranked_labelled(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    stored = ranking.latest_retrievals(table(spark, sf_dir, "job_candidate_rankings"))
    return stored.join(_one_label(spark, sf_dir).select("job_id", "resume_id", "label", *more), ["job_id", "resume_id"])


def stored_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the stored similarities against the relevance labels."""
    return evaluation.mean_metrics(evaluation.job_metrics(evaluation.by_score_field(_ranked_labelled(spark, sf_dir), ["semantic_similarity"])))


_PAIRED = _CLEAN + r""",
ret AS (SELECT job_id, resume_id, retrieval_rank, semantic_similarity FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY updated_at DESC NULLS LAST, semantic_similarity DESC NULLS LAST, retrieval_rank ASC NULLS LAST) AS v FROM job_candidate_rankings WHERE job_id IS NOT NULL AND resume_id IS NOT NULL) WHERE v = 1 AND semantic_similarity IS NOT NULL),
one AS (SELECT job_id, resume_id, max(label) AS label FROM lab GROUP BY 1, 2),
e AS (SELECT r.job_id, r.resume_id, o.label, coalesce(r.retrieval_rank, 0) AS rr, r.semantic_similarity AS value FROM ret r JOIN one o ON o.job_id = r.job_id AND o.resume_id = r.resume_id),
u AS (SELECT *, 'semantic_similarity' AS score_field, value AS score FROM e)"""
STORED_METRICS_SQL = _PAIRED + _EVENTS[_EVENTS.index(",\nk AS") :] + _MEAN


def feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of every retrieved pair with its label, one row a pair."""
    out = evaluation.labelled_export(_signals(spark, sf_dir), _one_label(spark, sf_dir))
    return out.select("job_id", "resume_id", "label", "split", "source", "final_score", "skill_coverage", "parser_quality_score")


FEATURE_EXPORT_SQL = _FEATURES + r""",
lab AS ("""+_CLEAN.split("WITH lab AS (",1)[1]+r""",
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY label DESC, split NULLS LAST, source NULLS LAST) AS v FROM lab) WHERE v = 1),
q AS ("""+QUALITY_SQL.removeprefix(_LATEST)+r"""),
b AS (SELECT job_id, (16 * (strpos('0123456789abcdef', substr(sha1(job_id), 1, 1)) - 1) + strpos('0123456789abcdef', substr(sha1(job_id), 2, 1)) - 1) / 255.0 AS share FROM job)
SELECT s.job_id, s.resume_id, o.label, coalesce(o.split, CASE WHEN b.share < 0.7 THEN 'train' WHEN b.share < 0.85 THEN 'validation' ELSE 'test' END) AS split, o.source, s.final_score, s.skill_coverage, q.quality AS parser_quality_score
FROM scored s JOIN q ON q.resume_id = s.resume_id JOIN b ON b.job_id = s.job_id LEFT JOIN one o ON o.job_id = s.job_id AND o.resume_id = s.resume_id"""


def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.export_summary(feature_export(spark, sf_dir))


EXPORT_SUMMARY_SQL = _CLEAN + r""",
p AS (SELECT DISTINCT resume_id FROM candidate_profiles), j AS (SELECT DISTINCT job_id FROM job_descriptions),
ret AS (SELECT job_id, resume_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY updated_at DESC, semantic_similarity DESC NULLS LAST) AS v FROM job_candidate_rankings) WHERE v = 1 AND semantic_similarity IS NOT NULL),
one AS (SELECT DISTINCT job_id, resume_id FROM lab),
x AS (SELECT r.job_id, l.job_id AS labelled FROM ret r SEMI JOIN p ON p.resume_id = r.resume_id SEMI JOIN j ON j.job_id = r.job_id LEFT JOIN one l ON l.job_id = r.job_id AND l.resume_id = r.resume_id)
SELECT count(*) AS rows, count(DISTINCT job_id) AS jobs, count(labelled) AS labelled_rows FROM x"""


def training_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of each split in the order in which a listwise learner reads them, with the size of each job's run."""
    stored = _ranked_labelled(spark, sf_dir, "split")
    return learning.training_order(stored.select("job_id", "resume_id", "label", "split", "retrieval_rank"))


TRAINING_SQL = _CLEAN + r""",
ret AS (SELECT job_id, resume_id, retrieval_rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY updated_at DESC NULLS LAST, semantic_similarity DESC NULLS LAST, retrieval_rank ASC NULLS LAST) AS v FROM job_candidate_rankings WHERE job_id IS NOT NULL AND resume_id IS NOT NULL) WHERE v = 1 AND semantic_similarity IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_id ORDER BY label DESC, split NULLS LAST, source NULLS LAST) AS v FROM lab) WHERE v = 1),
x AS (SELECT r.job_id, r.resume_id, o.label, o.split, r.retrieval_rank FROM ret r JOIN one o ON o.job_id = r.job_id AND o.resume_id = r.resume_id)
SELECT job_id, resume_id, label, split, retrieval_rank, CAST(row_number() OVER (PARTITION BY split, job_id ORDER BY CASE WHEN coalesce(retrieval_rank, 0) = 0 THEN 1000000000 ELSE retrieval_rank END, resume_id) AS INTEGER) AS place,
  CAST(count(*) OVER (PARTITION BY split, job_id) AS INTEGER) AS group_size FROM x"""


def reranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic and learned score compared by their metrics on rows that the model was not fitted on: those of the first split
    of test, validation and train that has any."""
    rows = cut(evaluation.labelled_export(_signals(spark, sf_dir), _one_label(spark, sf_dir), only_labelled=True))
    model = learning.train_ranker(rows)
    split = learning.evaluation_split(rows)
    both = learning.scored(model, rows.where(F.col("split") == split)).withColumnRenamed("final_score", "heuristic_score")
    metrics = evaluation.mean_metrics(evaluation.job_metrics(evaluation.by_score_field(both, ["heuristic_score", "ml_score"])))
    return metrics.select(F.lit(split).alias("split"), "*")


def queries() -> dict:
    own = [label_counts, label_summary, duplicate_labels, metrics_by_job, mean_metrics, stored_ranking_metrics, training_groups, feature_export, export_summary, reranker]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {"label_counts": LABEL_COUNTS_SQL, "label_summary": LABEL_SUMMARY_SQL, "duplicate_labels": DUPLICATES_SQL, "metrics_by_job": METRICS_SQL, "mean_metrics": MEAN_SQL, "export_summary": EXPORT_SUMMARY_SQL, "stored_ranking_metrics": STORED_METRICS_SQL, "training_groups": TRAINING_SQL, "feature_export": FEATURE_EXPORT_SQL}
