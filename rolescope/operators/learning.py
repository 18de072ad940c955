"""Learned re-ranking. Spark ML has no listwise ranker, so trees are boosted on the graded label itself (pointwise)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import NO_RANK

# Features of a scored pair.
FEATURES = (
    "semantic_similarity", "skill_coverage", "experience_alignment", "education_match", "role_relevance", "warning_count", "parser_quality_score", "education_count",
    "experience_count", "project_count", "skills_count", "has_name", "has_email", "has_phone", "required_skill_count", "preferred_skill_count",
)


def feature_matrix(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``features`` vector of each row; a missing or null feature is 0. All other columns stay."""
    from pyspark.ml.feature import VectorAssembler

    for f in features:
        c = F.col(f).cast("double") if f in rows.columns else F.lit(0.0)
        rows = rows.withColumn(f, F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def training_order(rows: DataFrame) -> DataFrame:
    """Labelled rows with ``place``, their order within the job's run of a split, by retrieval rank and id, and ``group_size``, the
    length of the run: what a listwise learner needs. A missing or zero rank comes last."""
    own = Window.partitionBy("split", "job_id")
    rank = F.when(F.coalesce("retrieval_rank", F.lit(0)) == 0, F.lit(NO_RANK)).otherwise(F.col("retrieval_rank"))
    place = F.row_number().over(own.orderBy(rank, "resume_id"))
    return rows.where("label is not null").withColumn("place", place).withColumn("group_size", F.count("*").over(own).cast("int"))


def train_ranker(export: DataFrame, features: tuple[str, ...] = FEATURES, rounds: int = 40, depth: int = 4, rate: float = 0.1, seed: int = 42):
    """Model fitted on the labelled rows of the train split; ValueError with fewer than two distinct labels there."""
    from pyspark.ml.regression import GBTRegressor

    train = export.where("split = 'train' and label is not null")
    if train.select("label").distinct().limit(2).count() < 2:
        raise ValueError("training needs two distinct labels")
    learner = GBTRegressor(featuresCol="features", labelCol="target", predictionCol="ml_score", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.9, seed=seed)
    return learner.fit(feature_matrix(train, features).withColumn("target", F.col("label").cast("double")))


def scored(model, export: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    return model.transform(feature_matrix(export, features)).drop("features").withColumn("ml_score", F.round("ml_score", 6))


def evaluation_split(export: DataFrame, order: tuple[str, ...] = ("test", "validation", "train")) -> str | None:
    """First split of ``order`` that holds a labelled row."""
    present = {r[0] for r in export.where("label is not null").select("split").distinct().limit(16).collect()}
    return next((s for s in order if s in present), None)
