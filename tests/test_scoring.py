import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rolescope.functions import documents, scoring, text
from rolescope.operators import ranking


def value(spark, column):
    return spark.range(1).select(column.alias("o")).first().o


def strings(*items):
    return F.array(*(F.lit(i).cast("string") for i in items)) if items else F.expr("cast(array() as array<string>)")


def test_skill_coverage(spark):
    c = lambda req, pref, own, txt, **k: value(spark, scoring.skill_coverage(strings(*req), strings(*pref), strings(*own), F.lit(txt), **k))
    assert c(["Python", "Spark"], ["Go"], ["python"], "used SPARK daily") == 0.7
    assert c(["Python"], [], [], "") == 0.0 and c([], ["Go"], ["go"], None) == 1.0 and c([], [], ["x"], "y") == 0.5
    # a substring of another word counts, unless whole words are asked for
    assert c(["java"], [], [], "javascript") == 1.0 and c(["java"], [], [], "javascript", match="token") == 0.0
    assert c(["C#"], [], [], "a cat") == 1.0
    assert c([None, "Go"], [], ["", None, "go"], "") == 1.0


@pytest.mark.parametrize(("asked", "least", "most"), [("2-4 years", 2, 4), ("3 - 5 Years exp", 3, 5), ("5+ years", 5, None), ("3 years", None, None), ("2–4 years", None, None), (None, None, None)])
def test_required_years(spark, asked, least, most):
    a, b = scoring.required_years(F.lit(asked).cast("string"))
    assert value(spark, F.struct(a, b)) == (least, most)


def profile(**members):
    return documents.document(F.lit(json.dumps(members)))


def test_candidate_years(spark):
    y = lambda entries: value(spark, scoring.profile_years(profile(experience=entries)))
    assert y([{"date_range": "2019-2022"}, {"raw_text": "Clerk 2010"}]) == 4.0
    assert y([{"date_range": "1990 - 2022"}]) == 20.0
    assert y([{"title": "x"}, {"raw_text": "y"}]) == 2.0 and y([]) == 0.0 and y({"date_range": "2015-2015"}) == 1.0


def test_alignment_and_education(spark):
    al = lambda asked, years: value(spark, scoring.experience_alignment(F.lit(asked).cast("string"), F.lit(float(years))))
    assert al("2-4 years", 3) == 1.0 and al("4+ years", 1) == 0.25 and al(None, 9) == 0.5 and al("2+ years", 0) == 0.0 and al("0-1 years", 1) == 1.0
    level = lambda t: value(spark, scoring.education_level(F.lit(t).cast("string")))
    assert [level(t) for t in ("PhD", "M.Tech CS", "Bachelor of Arts", "Class XII", "B.E.", "Ph.D", "program engineering", None)] == [4, 3, 2, 1, 2, 0, 3, 0]
    match = lambda job, own: value(spark, scoring.education_match(F.lit(job).cast("string"), F.lit(own)))
    assert (match("Bachelor", 2), match("Master", 2), match("Master", 0), match(None, 1), match(None, 0)) == (1.0, 0.5, 0.0, 0.5, 0.0)


def test_role_relevance_and_score(spark):
    rel = lambda a, b: value(spark, scoring.role_relevance(text.token_set(F.lit(a)), text.token_set(F.lit(b))))
    assert rel("Data Engineer", "data pipelines") == 1.0 and rel("Senior Data Analyst", "data") == 0.333333 and rel("Engineer", "x") == 0.0
    ones = {n: F.lit(1.0) for n in ("semantic_similarity", "skill_coverage", "experience_alignment", "education_match", "role_relevance")}
    assert value(spark, scoring.final_score(ones)) == 1.0


def test_quality(spark):
    q = lambda w, *flags: value(spark, scoring.parser_quality(F.lit(w).cast("int"), *(F.lit(f) for f in flags)))
    assert q(4, False, False, False, 0, 0) == 0.23 and q(None, True, True, True, 3, 1) == 1.0 and q(99, False, False, False, 0, 0) == 0.15


def test_split_bucket_equals_its_definition(spark):
    ids = [f"job_{k}" for k in range(200)]
    got = dict(spark.createDataFrame([(i,) for i in ids], "i string").select("i", scoring.split_bucket(F.col("i")).alias("s")).collect())
    for i in ids:
        share = hashlib.sha1(i.encode()).digest()[0] / 255
        assert got[i] == ("train" if share < 0.7 else "validation" if share < 0.85 else "test")


def test_documents_of_any_shape(spark):
    rows = [("[1]",), ("{bad",), (None,), ('{"a": null}',), ('{"a": {"t": "x"}}',), ('{"a": [{"t": "x"}, null, {"t": ""}]}',), (json.dumps('{"a": {"t": "y"}}'),)]
    got = spark.createDataFrame(rows, "j string").select(documents.entry_texts(documents.document(F.col("j")), "$.a", "t").alias("o")).collect()
    assert [r.o for r in got] == [[], [], [], [], ["x"], ["x"], ["y"]]


def test_ranking_over_tables(spark):
    jobs = spark.createDataFrame([("j1", "Data Engineer", ["Python"], None, "2+ years", "Bachelor")], "job_id string, job_title string, required_skills array<string>, preferred_skills array<string>, experience_required string, education string")
    doc = json.dumps({"experience": [{"date_range": "2019-2022"}], "education": [{"raw_text": "Bachelor of Science"}], "raw_text": "data"})
    prof = spark.createDataFrame(
        [("c1", "Ann", "a@b.c", None, ["Python"], 0, 0, 0, 0, doc), ("c2", None, None, None, None, None, None, None, 9, None)],
        "resume_id string, name string, email string, phone string, skills array<string>, education_count int, experience_count int, project_count int, warning_count int, profile_json string",
    )
    pairs = spark.createDataFrame([("j1", "c1", 2, 0.5), ("j1", "c2", 1, 0.5), ("j1", "gone", 3, 0.9), ("other", "c1", 1, 0.9)], "job_id string, resume_id string, retrieval_rank int, semantic_similarity double")
    got = ranking.ranked(ranking.signals(pairs, jobs, prof)).orderBy("ranking_rank").collect()
    assert [(r.resume_id, r.skill_coverage, r.experience_alignment, r.education_match, r.role_relevance, r.final_score) for r in got] == [("c1", 1.0, 1.0, 1.0, 1.0, 0.775), ("c2", 0.0, 0.0, 0.0, 0.0, 0.225)]
    assert got[0].education_count == 1 and got[1].parser_quality_score == 0.15 and got[1].has_email == 0.0


def test_embedding_texts(spark):
    doc = profile(experience=[{"raw_text": "Clerk"}], education={"raw_text": "BSc"}, sections={"achievements": "Prize"})
    assert value(spark, scoring.candidate_embedding_text(F.lit("Ann"), strings("Go", "SQL"), doc)) == "Candidate: Ann\nSkills: Go, SQL\nExperience: Clerk\nEducation: BSc\nAchievements: Prize"
    assert value(spark, scoring.candidate_embedding_text(F.lit(""), strings(), profile(raw_text="all"))) == "all"
    none = F.lit(None).cast("string")
    assert value(spark, scoring.job_embedding_text(F.lit("Clerk"), none, strings("a", "b"), strings("x"), strings(), none, strings())) == "Job Title: Clerk\nResponsibilities: a b\nRequired Skills: x"
