import random

import numpy as np
import pytest

from rolescope.operators import retrieval


def vectors(n, width=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_equals_brute_force(spark, block):
    v = vectors(60)
    v[7] = v[3]  # a tie
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "id long, e array<double>").repartition(5)
    queries = spark.createDataFrame([(k, v[k]) for k in range(0, 60, 6)], "q long, e array<double>")
    got = {(r.q, r.retrieval_rank): (r.id, r.similarity) for r in retrieval.top_k(queries, rows, "q", "id", "e", 5, block=block).collect()}
    m = np.array(v)
    for q in range(0, 60, 6):
        sim = np.round((np.round(m @ m[q], 10) + 1) / 2, 9)
        for rank, i in enumerate(sorted(range(60), key=lambda i: (-sim[i], i))[:5], 1):
            assert got[q, rank] == (i, pytest.approx(sim[i], abs=1e-9))


def test_odd_vectors_are_no_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])], "id long, e array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "q long, e array<double>")
    assert [(r.q, r.id, r.similarity) for r in retrieval.top_k(queries, rows, "q", "id", "e").collect()] == [(9, 1, 1.0)]
    assert retrieval.top_k(queries.limit(0), rows, "q", "id", "e").count() == 0
    assert retrieval.top_k(queries, rows.limit(0), "q", "id", "e").count() == 0
    with pytest.raises(ValueError):
        retrieval.top_k(queries, rows, "q", "id", "e", 0)


LIST = "job_id string, resume_id string, similarity double"


def merge(spark, stored, new, k):
    out = retrieval.merged_top_k(spark.createDataFrame(stored, LIST), spark.createDataFrame(new, LIST), k)
    return {(r.job_id, r.retrieval_rank): (r.resume_id, r.changed) for r in out.collect()}


def test_incremental_lists(spark):
    assert merge(spark, [("j", "c1", 0.91), ("j", "c2", 0.82)], [("j", "c3", 0.93)], 2) == {("j", 1): ("c3", True), ("j", 2): ("c1", True)}
    assert merge(spark, [("j", "c1", 0.91), ("j", "c2", 0.82)], [("j", "c3", 0.1)], 2) == {("j", 1): ("c1", False), ("j", 2): ("c2", False)}
    got = merge(spark, [("j", "c1", 0.91), ("j", "c2", 0.82), ("j", "c4", 0.74), ("k", "c2", 0.5)], [("j", "c2", 0.2)], 2)
    assert got == {("j", 1): ("c1", True), ("j", 2): ("c4", True), ("k", 1): ("c2", False)}
    assert merge(spark, [], [("j", "a", 0.5), ("j", "a", 0.6)], 2) == {("j", 1): ("a", True)}


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("a", "red green green"), ("b", "GREEN, green red!"), ("c", ""), ("d", None)], "id string, t string")
    got = dict(retrieval.hashed_vectors(df, "id", "t", 32).collect())
    assert got["a"] == got["b"] and sum(x * x for x in got["a"]) == pytest.approx(1.0)
    assert got["c"] == got["d"] == [0.0] * 32


def test_ranks_are_permutations(spark):
    rng = random.Random(2)
    v = vectors(30, 4, 9)
    rows = spark.createDataFrame([(k, x, rng.random()) for k, x in enumerate(v)], "id long, e array<double>, extra double")
    out = retrieval.top_k(rows.selectExpr("id as q", "e"), rows, "q", "id", "e", 30).collect()
    for q in range(30):
        assert sorted(r.retrieval_rank for r in out if r.q == q) == list(range(1, 31))


def test_an_encoder_of_ones_own(spark):
    def letters(texts):
        return np.array([[t.count(c) for c in "abc"] for t in texts])

    df = spark.createDataFrame([(1, "aab"), (2, None), (3, "c")], "id long, t string")
    got = {r.id: r.embedding for r in retrieval.encoded_vectors(df, "id", "t", letters, batch=2).collect()}
    assert got[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5, 0]) and got[2] == [0, 0, 0] and got[3] == [0, 0, 1]
    assert retrieval.encoded_vectors(df.limit(0), "id", "t", letters).count() == 0

