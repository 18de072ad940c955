import math
import random

import pytest

from rolescope.operators import evaluation, learning

ROWS = "job_id string, resume_id string, label int, retrieval_rank int, heuristic_score double"


def metrics(spark, rows, **k):
    df = spark.createDataFrame(rows, ROWS)
    return evaluation.job_metrics(evaluation.by_score_field(df, ["heuristic_score"]), **k)


def test_known_values(spark):
    r = metrics(spark, [("j", "a", 3, 1, 0.91), ("j", "b", 0, 2, 0.5), ("j", "c", 1, 3, 0.4)]).first()
    assert (r.precision_at_k, r.recall_at_k, r.ndcg_at_k) == (0.666667, 1.0, 0.982842)
    assert metrics(spark, [("j", str(k), 3 - k, None, 1.0 - k / 9) for k in range(4)]).first().ndcg_at_k == 1.0


def test_ties_missing_ranks_and_nulls(spark):
    rows = [("j", "b", 1, 0, 0.5), ("j", "a", 0, 7, 0.5), ("j", "c", 3, None, None), ("j", "d", None, 1, 0.9), ("k", "x", 0, 1, 0.1)]
    got = {r.job_id: r for r in metrics(spark, rows).collect()}
    # equal scores: rank 7 before the zero rank, which counts as missing
    assert got["j"].labeled_pair_count == 2 and got["j"].ndcg_at_k == round(1 / math.log2(3), 6)
    assert (got["k"].precision_at_k, got["k"].recall_at_k, got["k"].ndcg_at_k) == (0.0, 0.0, 0.0)
    mean = evaluation.mean_metrics(metrics(spark, rows)).first()
    assert (mean.jobs_with_labels, mean.jobs_with_relevant_labels, mean.labeled_pair_count) == (2, 1, 3)
    assert metrics(spark, []).count() == 0


def test_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(f"j{rng.randrange(6)}", f"r{k}", rng.randrange(4), rng.randrange(9), round(rng.random(), 1)) for k in range(120)]
    got = {r.job_id: (r.precision_at_k, r.recall_at_k, r.ndcg_at_k) for r in metrics(spark, rows).collect()}
    for job in {r[0] for r in rows}:
        own = [r[2] for r in sorted((r for r in rows if r[0] == job), key=lambda r: (-r[4], r[3] or 10**9, r[1]))]
        dcg = lambda ls: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(ls[:10]))
        relevant = sum(x > 0 for x in own)
        ideal = dcg(sorted(own, reverse=True))
        want = (sum(x > 0 for x in own[:5]) / min(5, len(own)), sum(x > 0 for x in own[:10]) / relevant if relevant else 0, dcg(own) / ideal if ideal else 0)
        assert got[job] == pytest.approx(want, abs=1e-6)


LABELS = "job_id string, resume_id string, label int, split string, source string, notes string"


def test_labels(spark):
    raw = spark.createDataFrame([(" j ", "r\n", 1, "Val", " ", None), ("j", "s", 0, None, "x", " n ")], LABELS)
    got = [tuple(r) for r in evaluation.clean_labels(raw).collect()]
    assert got == [("j", "r", 1, "validation", None, None), ("j", "s", 0, None, "x", "n")]
    bad = spark.createDataFrame([("j", "r", -1, "train", None, None), ("j", "s", None, "odd", None, None), ("j", "t", 2, "odd", None, None)], LABELS)
    with pytest.raises(Exception, match="negative|unsupported"):
        evaluation.clean_labels(bad).collect()
    assert [r.resume_id for r in evaluation.clean_labels(bad, strict=False).collect()] == ["t"]
    s = evaluation.label_summary(evaluation.clean_labels(raw)).first()
    assert (s.label_count, s.job_count, s.resume_count, s.split_counts, s.label_counts) == (2, 1, 2, {"validation": 1, "unspecified": 1}, {"0": 1, "1": 1})


def test_duplicates_are_an_error(spark):
    df = spark.createDataFrame([("j", "r", 1), ("j", "r", 2), ("k", "r", 1)], "job_id string, resume_id string, label int")
    assert [tuple(r) for r in evaluation.duplicate_keys(df, ["job_id", "resume_id"]).collect()] == [("j", "r", 2)]
    with pytest.raises(Exception, match="duplicate key: j, r"):
        evaluation.unique_or_error(df, ["job_id", "resume_id"]).collect()
    assert evaluation.unique_or_error(df.where("job_id = 'k'"), ["job_id"]).count() == 1


def test_learned_ranker(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        x = rng.random()
        rows.append((f"j{k % 10}", f"r{k}", x, int(x * 3.99), "train" if k % 10 < 7 else "test"))
    df = spark.createDataFrame(rows, "job_id string, resume_id string, skill_coverage double, label int, split string")
    model = learning.train_ranker(df, rounds=5, depth=2)
    out = learning.scored(model, df)
    assert out.where("split = 'test'").stat.corr("ml_score", "skill_coverage") > 0.9
    assert learning.evaluation_split(df) == "test"
    with pytest.raises(ValueError, match="two distinct labels"):
        learning.train_ranker(df.where("label = 1"))


def test_registered_reranker_fits_the_operators_trees(spark, data, monkeypatch):
    import inspect

    from rolescope.operators import learning
    from rolescope.plans import evaluating

    given = {}

    def train(*args, **kwargs):
        given.update(inspect.signature(original).bind(*args, **kwargs).arguments)
        raise StopIteration

    original = learning.train_ranker
    monkeypatch.setattr(learning, "train_ranker", train)
    try:
        evaluating.reranker(spark, data)
    except StopIteration:
        pass
    plain = inspect.signature(original).parameters
    assert given and [given.get(k, plain[k].default) for k in ("rounds", "depth")] == [40, 4]
