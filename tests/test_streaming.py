import json

from rolescope.sources import uploads
from rolescope.streaming.topology import Bus, Pipeline, decoded
from tests.test_structure import RESUME


def test_decoding(spark):
    rows = [("k", '{"resume_id": "r", "source_path": "/p"}'), ("k", ""), ("k", "{bad"), ("k", None), ("k", '{"resume_id": " "}')]
    got = [r.error for r in decoded(spark.createDataFrame(rows, "key string, value string"), "resume.uploaded", ("resume_id", "source_path")).collect()]
    assert got == [None, "missing resume_id, source_path", "malformed", "malformed", "missing resume_id, source_path"]


def test_uploads_become_rankings(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "ann.txt").write_text(RESUME)
    (land / "bob.txt").write_text("Bob Oak\nSKILLS\nGo, Rust\n")
    bus = Bus(spark, folder=str(tmp_path / "bus"))
    p = Pipeline(spark, str(tmp_path / "state"), bus, width=64, top_k=2)
    jobs = spark.createDataFrame([("j1", "Data Engineer", ["Python", "Spark"], ["Git"], "2+ years", "Bachelor"), ("j2", "Gardener", ["Roses"], [], None, None)], "job_id string, job_title string, required_skills array<string>, preferred_skills array<string>, experience_required string, education string")
    p.tables["jobs"].replace(jobs)
    from rolescope.operators.retrieval import hashed_vectors

    p.tables["job_vectors"].replace(hashed_vectors(jobs.selectExpr("job_id", "concat_ws(' ', job_title, array_join(required_skills, ' ')) as t"), "job_id", "t", 64))
    checked = uploads.checked(spark.createDataFrame([("ann.txt", 10), ("bob.txt", 10), ("gone.txt", 10)], "filename string, size_bytes long"))
    bus.publish(uploads.upload_events(checked, str(land)), "resume.uploaded")
    bus.publish(spark.createDataFrame([("x", '{"resume_id": ""}')], "key string, value string"), "resume.uploaded")
    p.drain()
    assert {(r.resume_id, r.email) for r in p.tables["profiles"].read().collect()} == {("ann", "ann.lee@example.org"), ("bob", None)}
    ranked = {(r.job_id, r.resume_id): r for r in p.tables["rankings"].read().collect()}
    assert set(ranked) == {("j1", "ann"), ("j1", "bob"), ("j2", "ann"), ("j2", "bob")}
    assert ranked["j1", "ann"].ranking_rank == 1 and ranked["j1", "ann"].skill_coverage == 1.0
    dead = {r.error for r in spark.read.parquet(str(tmp_path / "state" / "dead_letters")).collect()}
    assert dead == {"no such file", "missing resume_id, source_path"}
    out = [json.loads(r.value) for r in spark.read.json(str(tmp_path / "bus" / "candidate.ranked")).collect()]
    assert {e["resume_id"] for e in out} == {"ann", "bob"} and all(e["job_count"] == 2 for e in out)
    # A second run has nothing to do; the same event again changes nothing but times.
    before = {(r.job_id, r.resume_id, r.final_score) for r in ranked.values()}
    p.drain()
    bus.publish(uploads.upload_events(checked.where("filename = 'ann.txt'"), str(land)), "resume.uploaded")
    p.drain()
    assert {(r.job_id, r.resume_id, r.final_score) for r in p.tables["rankings"].read().collect()} == before


def test_each_candidate_of_a_batch_has_its_own_jobs(spark):
    from rolescope.operators import retrieval

    stored = spark.createDataFrame([("j1", "a", 0.9), ("j1", "b", 0.8), ("j2", "b", 0.7), ("j2", "c", 0.6), ("j3", "a", 0.5), ("j3", "d", 0.4)], "job_id string, resume_id string, similarity double")
    near = spark.createDataFrame([("j1", "x", 0.85), ("j2", "x", 0.1), ("j3", "x", 0.1), ("j1", "y", 0.1), ("j2", "y", 0.65), ("j3", "y", 0.2), ("j1", "z", 0.0), ("j2", "z", 0.0), ("j3", "z", 0.0), ("j1", "d", 0.0), ("j2", "d", 0.0), ("j3", "d", 0.1)], "job_id string, resume_id string, similarity double")
    fresh = spark.createDataFrame([("x",), ("y",), ("z",), ("d",)], "resume_id string")
    merged = retrieval.merged_top_k(retrieval.without_outdated(stored, near, fresh), near, 2)
    got = {r.resume_id: r.affected_job_ids for r in retrieval.affected_jobs(stored, merged, fresh).collect()}
    assert got == {"x": ["j1"], "y": ["j2", "j3"], "z": [], "d": ["j3"]}
    assert {(r.job_id, r.resume_id) for r in merged.collect()} == {("j1", "a"), ("j1", "x"), ("j2", "b"), ("j2", "y"), ("j3", "a"), ("j3", "y")}


def test_three_candidates_in_one_batch(spark, tmp_path):
    land = tmp_path / "state" / "land"
    land.mkdir(parents=True)
    for name, skills in (("ann", "python spark python spark"), ("bob", "roses soil roses soil"), ("cem", "welding steel welding steel")):
        (land / f"{name}.txt").write_text(f"{name.title()} Oak\nSKILLS\n{skills}\n")
    bus = Bus(spark, folder=str(tmp_path / "bus"))
    p = Pipeline(spark, str(tmp_path / "state"), bus, width=256, top_k=1)
    jobs = spark.createDataFrame([("j1", "python spark", ["Python"], [], None, None), ("j2", "roses soil", ["Roses"], [], None, None)], "job_id string, job_title string, required_skills array<string>, preferred_skills array<string>, experience_required string, education string")
    p.tables["jobs"].replace(jobs)
    from rolescope.operators.retrieval import hashed_vectors

    p.tables["job_vectors"].replace(hashed_vectors(jobs.selectExpr("job_id", "job_title as t"), "job_id", "t", 256))
    # relative paths lie below the root
    events = [(n, json.dumps({"resume_id": n, "source_filename": f"{n}.txt", "source_path": f"land/{n}.txt", "uploaded_at": "x"})) for n in ("ann", "bob", "cem")]
    bus.publish(spark.createDataFrame(events, "key string, value string").coalesce(1), "resume.uploaded")
    p.drain()
    told = {e["resume_id"]: e["affected_job_ids"] for e in (json.loads(r.value) for r in spark.read.json(str(tmp_path / "bus" / "resume.embedded")).collect())}
    assert told == {"ann": ["j1"], "bob": ["j2"], "cem": []}
    out = {e["resume_id"]: (e["job_ids"], e["job_count"], e["ranked_candidate_count"]) for e in (json.loads(r.value) for r in spark.read.json(str(tmp_path / "bus" / "candidate.ranked")).collect())}
    assert out == {"ann": (["j1"], 1, 1), "bob": (["j2"], 1, 1), "cem": ([], 0, 0)}
