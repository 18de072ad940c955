"""Top N, rank fusion, and the package's queries against their SQL."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolescope.llm import group_topn, queries, rank_fusion
from tests import oracle

RANK = "job_id string, resume_id string, retrieval_rank int, final_score double, updated_at int, pos int"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    oracle.check(spark, queries.queries(), queries.oracle_sql(), name, data)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


def test_best_candidates(spark):
    rows = [("j", "a", 1, 0.5, 1, 0), ("j", "a", 1, 0.2, 2, 0), ("j", "b", 2, 0.5, 1, 0), ("j", "c", 1, 0.5, 1, 0), ("j", "d", None, 0.5, 1, 0), ("j", "e", 1, None, 1, 0), ("j", "f", 1, float("nan"), 1, 0), ("j", "c", 1, 0.5, 1, 0), ("k", "z", 1, 0.1, None, 0), (None, "n", 1, 0.9, 1, 0)]
    df = spark.createDataFrame(rows, RANK)
    got = [tuple(r) for r in group_topn.best_candidates(df, 3).orderBy("job_id", "pos").collect()]
    assert got == [(None, "n", 1), ("j", "c", 1), ("j", "b", 2), ("j", "d", 3), ("k", "z", 1)]
    assert group_topn.best_candidates(df.limit(0)).count() == 0
    again = group_topn.top_n(df, ["job_id"], "final_score", [F.col("resume_id")], 1)
    assert {(r.job_id, r.resume_id, r.pos) for r in again.collect()} == {(None, "n", 1), ("j", "a", 1), ("k", "z", 1)}
    with pytest.raises(ValueError):
        group_topn.top_n(df, ["job_id"], "final_score", [], 0)


def test_the_limit_prunes_before_the_shuffle(spark):
    df = group_topn.top_n(spark.range(1000).selectExpr("id % 3 as g", "id as s"), ["g"], "s", [F.col("s")], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


SIGNALS = {"up": 1, "down": -1}


def test_ranks_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [("g" + str(k % 3), str(k), rng.choice([None, 0.0, 1.0, float("nan"), rng.random()]), float(rng.randrange(5))) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, i string, up double, down double")
    every = df.select("g").distinct()
    for large, bucket in ((None, 50_000), (every, 50_000), (every, 5), (every.where("g <> 'g1'"), 5)):
        got = {(r.g, r.i): (r.r_up, r.r_down) for r in rank_fusion.ranked_signals(df, "g", "i", SIGNALS, large, bucket).collect()}
        for g, i, up, down in rows:
            own = [r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]]
            want = 0.0 if up is None or up != up else (sum(x < up for x in own) + sum(x == up for x in own) / 2) / len(own) - 0.5
            other = [-r[3] for r in rows if r[0] == g]
            want_down = (sum(x < -down for x in other) + sum(x == -down for x in other) / 2) / len(other) - 0.5
            assert got[g, i] == pytest.approx((want, want_down))


def test_loadings_follow_the_declared_directions():
    m = np.array([[1, 0.6, -0.4], [0.6, 1, -0.3], [-0.4, -0.3, 1]])
    w = rank_fusion.loadings(m)
    assert (w > 0).all() and w.sum() == pytest.approx(1) and w[0] > w[2]
    assert rank_fusion.loadings(np.zeros((4, 4))).tolist() == [0.25] * 4


def test_units_have_no_say(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        x = rng.random()
        rows.append(("j", f"r{k:02d}", 1, x, x + rng.random() / 4, x + rng.random() / 4, rng.choice([0.0, 0.5, 1.0]), 1, None))
    schema = "job_id string, resume_id string, retrieval_rank int, semantic_similarity double, skill_coverage double, experience_alignment double, education_match double, updated_at int, fused double"
    df = spark.createDataFrame(rows, schema)
    jobs = spark.createDataFrame([("j",), ("j",), (None,), ("gone",)], "job_id string")
    first = [tuple(r)[:2] for r in rank_fusion.joint_ranking(df, jobs, None).orderBy("pos").select("job_id", "resume_id").collect()]
    scaled = df.withColumn("skill_coverage", F.col("skill_coverage") * 100).withColumn("experience_alignment", F.exp(F.col("experience_alignment") * 9))
    assert [tuple(r) for r in rank_fusion.joint_ranking(scaled, jobs, None).orderBy("pos").select("job_id", "resume_id").collect()] == first
    assert rank_fusion.joint_ranking(df, jobs).count() == 3 and rank_fusion.joint_ranking(df.limit(0), jobs).count() == 0 and rank_fusion.joint_ranking(df, jobs.limit(0)).count() == 0


def test_a_ranking_does_not_depend_on_the_jobs_that_are_asked(spark, data):
    rankings = spark.read.parquet(f"{data}/job_candidate_rankings.parquet")
    whole = {(r.job_id, r.resume_id): r.pos for r in rank_fusion.joint_ranking(rankings, None, None).collect()}
    jobs = spark.read.parquet(f"{data}/fusion_jobs.parquet")
    for rows in (10**6, 20):
        got = [tuple(r) for r in rank_fusion.joint_ranking(rankings, jobs.limit(2), group_rows=rows).select("job_id", "resume_id", "pos").collect()]
        assert got and all(whole[j, r] == pos for j, r, pos in got)
