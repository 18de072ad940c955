"""Components, shredding, sections, parsing, audit and store."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from rolescope.functions import json_tree, resume
from rolescope.operators import audit, profiles, quality, sections, shredding, versions
from rolescope.operators.components import connected_components
from rolescope.operators.positions import positions
from rolescope.sources import files, settings, store, uploads


# ---- components

def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 330)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame([*edges, *edges[:9], (None, 5), (7, None)], "a int, b int")
    assert dict(connected_components(df, "a", "b").collect()) == want
    assert connected_components(df.limit(0), "a", "b").count() == 0


# ---- latest rows

def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("b", None, "z"), (None, 2, "n"), (None, 1, "m")], "k string, v int, t string")
    got = {tuple(r) for r in versions.latest_rows(df, ["k"], "v", [F.col("t")]).collect()}
    assert got == {("a", 3, "y"), ("b", None, "z"), (None, 2, "n")}


def test_positions_equal_row_number(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1.0, 2.0, rng.random()]), k, "x") for k in range(400)]
    df = spark.createDataFrame(rows, "g string, s double, i int, at string").repartition(7)
    got = {r.i: r.at for r in positions(df, ["g"], [F.col("s").desc_nulls_last(), F.col("i").asc()], "at").collect()}
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    assert positions(df.limit(0), ["g"], [F.col("i")], "at").count() == 0


# ---- shredding

DOCS = [
    ("lists", {"education": [{"degree": "BSc"}, None, {"degree": "MSc", "year": 2010}], "projects": [{"name": "p", "technologies": ["Go", None, "C"]}, {"technologies": "SQL"}], "certifications": ["c1"], "metadata": {"warnings": ["w"]}}),
    ("lone", {"education": {"degree": "PhD", "score": 7.10}, "projects": {"technologies": ["X"]}, "certifications": "only", "experience": None, "metadata": {"warnings": None}}),
    ("empty", {}),
    ("array", [1, 2]),
]


def tree(spark):
    rows = [(k, json.dumps(d), "extra", 1) for k, d in DOCS] + [("double", json.dumps(json.dumps(DOCS[1][1])), "extra", 2), ("bad", "{nope", None, 3), ("null", None, None, 4), ("blank", "", None, 5)]
    return shredding.adjacency(spark.createDataFrame(rows, "id string, doc string, node string, parent int"), "id", "doc")


def test_records_of_every_shape(spark):
    got = {tuple(r) for r in shredding.entity_index(tree(spark)).collect()}
    lone = {("education", -1, 0), ("project", -1, 0), ("technology", 0, 0), ("certification", -1, 0)}
    want = {("lists", *x) for x in [("education", -1, 0), ("education", -1, 2), ("project", -1, 0), ("project", -1, 1), ("technology", 0, 0), ("technology", 0, 2), ("technology", 1, 0), ("certification", -1, 0), ("warning", -1, 0)]}
    assert got == want | {("lone", *x) for x in lone} | {("double", *x) for x in lone}


def test_flat_tables(spark):
    t = tree(spark)
    edu = {(r.key, r.pos): (r.degree, r.year, r.score) for r in shredding.entity_table(t, "education").collect()}
    assert edu == {("lists", 0): ("BSc", None, None), ("lists", 2): ("MSc", "2010", None), ("lone", 0): ("PhD", None, "7.1"), ("double", 0): ("PhD", None, "7.1")}
    assert {(r.key, r.parent_pos, r.pos, r.value) for r in shredding.entity_table(t, "technology").where("key = 'lists'").collect()} == {("lists", 0, 0, "Go"), ("lists", 0, 2, "C"), ("lists", 1, 0, "SQL")}
    assert {r.key for r in t.where("kind = 'malformed'").collect()} == {"bad", "blank"}
    assert shredding.entity_index(t.limit(0)).count() == 0


def test_any_depth_and_round_trip():
    deep = "[" * 50_000 + "1" + "]" * 50_000
    assert sum(1 for _ in json_tree.document_nodes(deep)) == 50_001
    with pytest.raises(ValueError):
        json_tree.parse("[" * 50_000 + "1" + "]" * 49_999)

    def rebuild(nodes):
        values = {}
        for node, parent, label, _, kind, scalar in nodes:
            v = {"object": dict, "array": list, "null": lambda: None}.get(json_tree.KINDS[kind], lambda s=scalar: s)()
            values[node] = v
            if parent >= 0:
                holder = values[parent]
                holder.append(v) if isinstance(holder, list) else holder.__setitem__(label, v)
        return values[0]

    doc = {"b": [{"x": "1", "y": None}, [], {}, "ü\n"], "a": {"": {"k": "v"}}}
    assert rebuild(json_tree.document_nodes(json.dumps(doc))) == doc
    assert json_tree._parse_deep(json.dumps(doc)) == doc


# ---- sections and blocks

def test_forward_fill_and_blocks(spark):
    text = "Ann\n\nSKILLS\nPython\nEducation\nBSc\n\nMSc"
    numbered = sections.lines(spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "k string, t string"), "k", "t")
    got = {(r.k, r.section): r.text for r in sections.section_texts(numbered, "k").collect()}
    assert got == {("d", "header"): "Ann", ("d", "skills"): "Python", ("d", "education"): "BSc\n\nMSc"}
    own = sections.blocks(numbered, ["k"], F.col("line").startswith("Edu"))
    assert [(r.line, r.block) for r in own.orderBy("line_no").collect()] == [("Ann", 1), ("SKILLS", 2), ("Python", 2), ("Education", 3), ("BSc", 3), ("MSc", 4)]


def test_blocks_equal_a_walk(spark):
    rng = random.Random(8)
    docs = [(k, "\n".join(rng.choice(["", "x", "S y"]) for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    numbered = sections.lines(spark.createDataFrame(docs, "k int, t string"), "k", "t")
    got = {}
    for r in sections.blocks(numbered, ["k"], F.col("line").startswith("S")).collect():
        got.setdefault((r.k, r.block), []).append((r.line_no, r.line))
    for k, t in docs:
        want = resume.blocks_of(t.split("\n"), lambda line: line.startswith("S"))
        assert [[x for _, x in sorted(got[key])] for key in sorted(key for key in got if key[0] == k)] == want


def test_job_parts(spark):
    text = "Job Title: Clerk\nLocation: Here\nEmployment Type: Full\nExperience Required: 2-4 years\n\nAbout the Role\nA job.\nGood.\nKey Responsibilities:\n- sort\n- file\nREQUIRED SKILLS\n- SQL\n-Go\nPreferred Skills:\n- Rust\nEducation:\nBSc\nunder\nGood Fit Indicators\n- calm\nLocation: There\nlost line"
    df = spark.createDataFrame([("j", text), ("k", "no labels"), ("n", None)], "job_id string, raw_text string")
    got = {r.job_id: r for r in sections.job_parts(df).collect()}
    j = got["j"]
    assert (j.job_title, j.location, j.about, j.responsibilities, j.required_skills, j.preferred_skills, j.education, j.good_fit_indicators) == ("Clerk", "There", "A job. Good.", ["sort", "file"], ["SQL", "Go"], ["Rust"], "BSc under", ["calm"])
    assert got["k"].job_title is None and got["k"].required_skills == [] and "n" not in got
    with pytest.raises(Exception, match="no job title in k"):
        sections.job_parts(df, strict=True).collect()


# ---- parsing

RESUME = """ANN MARIA LEE
email: Ann.Lee@Example.org
Phone: +91-98765 43210

EDUCATION
Year      Degree/Certificate      Institute/School      CGPA
2018-2020    M.Tech Computer Science    Elm Institute of Technology    9.1/10
2014-2018    B.Tech Electronics    Oak College    85%
             Honours

SKILLS
Languages: Python, C++ and object-oriented c++11
Tools: node.js | Git, Programming Languages

WORK EXPERIENCE
Data Engineer    Acme Corp    Jan 2020 - Mar 2022
- built pipelines
  on Spark

Analyst intern at Beta (2019)
• wrote reports

PROJECTS
Guide: Prof. Oak

TOPIC
Search of
Graphs
WORK DONE
used Python and MySQL

Chat Bot    Jan 2019 - Mar 2019
made a bot

CERTIFICATIONS
• Spark Certified
spark certified
"""


def test_parsed_resume():
    r = resume.parsed(RESUME)
    assert r["name"] == "Ann Maria Lee"
    assert r["skills"] == sorted(["C", "C++", "Git", "MySQL", "Node.js", "Object-Oriented C++11", "Python", "Spark"], key=str.lower)
    assert [(e[1], e[2], e[3], e[4]) for e in r["education"]] == [("M.Tech", "Elm Institute of Technology", "2018-2020", "9.1/10"), ("B.Tech", "Oak College Honours", "2014-2018", "85%")]
    assert [(e[1], e[2], e[3], e[4]) for e in r["experience"]] == [("Data Engineer", "Acme Corp", "Jan 2020 - Mar 2022", "built pipelines on Spark"), ("Analyst intern at Beta (2019)", None, "(2019)", "wrote reports")]
    assert [(p[1], p[2], p[3]) for p in r["projects"]] == [("Search of Graphs", "used Python and MySQL", ["MySQL", "Python"]), ("Chat Bot", "made a bot", [])]
    assert r["certifications"] == ["Spark Certified"]


def test_running_education_lines():
    got = resume.education_of(["Degrees", "Bachelor of Arts, Oak College 2010", "with honours", "Master of Science 2012 CGPA: 8.5"])
    assert [(e[1], e[3], e[4]) for e in got] == [("Bachelor", "2010", None), ("Master", "2012", "CGPA: 8.5")]
    assert got[0][0].startswith("2010 Bachelor of Arts, Oak College 2010 with honours")


def test_odd_texts_parse_to_nothing():
    for text in ("", "   \n\n", "x" * 200_000, "\n" * 1000):
        r = resume.parsed(text)
        assert r["name"] is None and r["education"] == [] and r["projects"] == []


def test_profiles_from_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "ann.txt").write_bytes(RESUME.encode() + b"\xff\xfe")
    (tmp_path / "in" / "sub" / "empty.TXT").write_text(" \n ")
    (tmp_path / "in" / "sub" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "skip.md").write_text("no")
    import zipfile

    with zipfile.ZipFile(tmp_path / "in" / "doc.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Bob Oak</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Skills</w:t></w:r></w:p><w:p><w:r><w:t>Go</w:t></w:r></w:p></w:body></w:document>')
    folder = str(tmp_path / "in")
    listed = files.listed(spark, folder)
    assert {r.relative_path for r in listed.collect()} == {"ann.txt", "sub/empty.TXT", "sub/bad.docx", "doc.docx"}
    texts = files.extracted(files.contents(spark, folder)).cache()
    by = {r.path.rsplit("/", 1)[-1]: r for r in texts.collect()}
    assert by["doc.docx"].text == "Bob Oak\nSkills\nGo" and by["bad.docx"].text is None and "BadZipFile" in by["bad.docx"].error and by["empty.TXT"].warnings == [files.EMPTY]
    rows = {r.resume_id: r for r in profiles.profiles(texts.where("error is null"), "2024-01-01 00:00:00").collect()}
    assert rows["ann"].email == "ann.lee@example.org" and rows["ann"].phone == "+919876543210" and rows["ann"].education_count == 2 and rows["ann"].warning_count == 0
    assert rows["doc"].name == "Bob Oak" and rows["doc"].skills == ["Go"] and rows["empty"].warning_count == 4
    assert json.loads(rows["ann"].profile_json)["metadata"]["file_type"] == "txt"
    assert files.contents(spark, folder, limit=1).count() == 1
    missing = {r.field: r.profiles for r in quality.field_summary(profiles.profiles(texts.where("error is null"))).collect()}
    assert missing["email"] == 2 and missing["name"] == 1 and missing["projects"] == 2


def test_job_files_and_json_lines(spark, tmp_path):
    (tmp_path / "a clerk.txt").write_text("Job Title: Clerk\n")
    (tmp_path / "labels.jsonl").write_text('{"job_id": " j ", "resume_id": "r", "label": 1, "split": "val"}\n\n{"job_id": "j", "resume_id": "s", "label": 0}\n')
    (tmp_path / "bad.jsonl").write_text('{"job_id": "j", \n')
    assert [(r.job_id, r.raw_text) for r in files.job_texts(spark, str(tmp_path)).collect()][0][1] == "Job Title: Clerk"
    assert {(r.job_id, r.resume_id, r.split) for r in files.label_file(spark, str(tmp_path / "labels.jsonl")).collect()} == {("j", "r", "validation"), ("j", "s", None)}
    with pytest.raises(Exception):
        files.label_file(spark, str(tmp_path / "bad.jsonl")).collect()


# ---- audit

def test_audit(spark):
    rows = [
        ("a/Ann Lee.pdf", 100), ("b/Ann Lee.docx", 90), ("c/ann lee.pdf", 100), ("d/Ann_Lee (1).pdf", 99), ("e/Anne Leeman.pdf", 98), ("f/Anne Leemann.pdf", 97),
        ("g/sample ann lee.pdf", 5), ("h/resume.pdf", 0), ("i/resume.txt", 0), ("j/Zed Oak.pdf", 7), ("j/Zed Oak.pdf", 7), (None, 1),
    ]
    f = audit.file_features(spark.createDataFrame(rows, "relative_path string, size_bytes long"))
    got = {(r.rule, r.key): r.files for r in audit.groups(f, "same stem").unionByName(audit.groups(f, "extension only")).unionByName(audit.groups(f, "case only")).unionByName(audit.groups(f, "marker")).collect()}
    assert got == {("same stem", "Ann Lee"): 2, ("same stem", "resume"): 2, ("extension only", "Ann Lee"): 2, ("extension only", "resume"): 2, ("case only", "ann lee"): 3, ("marker", "annlee"): 4}
    near = {(r.left, r.right) for r in audit.near_links(f).collect()}
    assert near == {("e/Anne Leeman.pdf", "f/Anne Leemann.pdf")}
    review = {}
    for r in audit.review_groups(f).collect():
        review.setdefault(r.group, set()).add(r.relative_path)
    assert review == {"a/Ann Lee.pdf": {"a/Ann Lee.pdf", "b/Ann Lee.docx", "c/ann lee.pdf", "d/Ann_Lee (1).pdf"}, "e/Anne Leeman.pdf": {"e/Anne Leeman.pdf", "f/Anne Leemann.pdf"}, "h/resume.pdf": {"h/resume.pdf", "i/resume.txt"}}
    lines = [r.line for r in audit.report(f).orderBy("line_no").collect()]
    assert lines[0] == "# File audit" and "- files: 10" in lines and any("review `a/Ann Lee.pdf`" in line for line in lines)
    assert audit.review_groups(f.limit(0)).count() == 0


def test_near_links_equal_all_pairs(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    names = []
    for _ in range(25):
        base = f"{letters(rng.randrange(4, 12))} {letters(rng.randrange(4, 14))}"
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(1, len(x))
                x[k : k + 1] = rng.choice([[], [x[k], rng.choice("abcdef")], [rng.choice("abcdef")]])
            names.append("".join(x))
    rows = [(f"d{k}/{n}.pdf", rng.choice([0, 90, 100])) for k, n in enumerate(names)]
    f = audit.file_features(spark.createDataFrame(rows, "relative_path string, size_bytes long"))
    recs = sorted(f.collect(), key=lambda r: r.relative_path)
    want = set()
    for i, a in enumerate(recs):
        for b in recs[i + 1 :]:
            ca, cb = a.candidate_compact, b.candidate_compact
            if not (a.is_informative and b.is_informative) or a.is_template or b.is_template or ca == cb or ca[:1] != cb[:1] or abs(len(ca) - len(cb)) > 4:
                continue
            from difflib import SequenceMatcher

            s = SequenceMatcher(None, ca, cb).ratio()
            ratio = 0 if 0 in (a.size_bytes, b.size_bytes) else min(a.size_bytes, b.size_bytes) / max(a.size_bytes, b.size_bytes)
            over = len(set(a.tokens) & set(b.tokens)) / min(len(set(a.tokens)), len(set(b.tokens))) >= 0.75
            holds = ca in cb or cb in ca
            if s >= 0.92 and (over or holds or ratio >= 0.7) or over and (s >= 0.84 or ratio >= 0.85 or holds):
                want.add((a.relative_path, b.relative_path))
    assert len(want) > 40 and {(r.left, r.right) for r in audit.near_links(f).collect()} == want


def test_near_links_at_the_limits_of_length(spark):
    from difflib import SequenceMatcher

    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz01") for _ in range(n))
    # Four letters added, one in each quarter of 23, leave a similarity of exactly 0.92.
    base = "mabcdefghijklnopqrstuvw"
    keys = [base, base[:3] + "0" + base[3:9] + "1" + base[9:15] + "2" + base[15:20] + "3" + base[20:]]
    for n in range(8, 64):
        for _ in range(3):
            x = list("q" + letters(n - 1))
            keys.append("".join(x))
            for _ in range(rng.randrange(1, 3 + n // 12)):
                k = rng.randrange(1, len(x))
                x[k : k + 1] = rng.choice([[], [x[k], rng.choice("aez1")], [rng.choice("aez1")], [x[k], x[k]]])
            keys.append("".join(x))
    f = audit.file_features(spark.createDataFrame([(f"d{k:04d}/{key}.pdf", 100) for k, key in enumerate(keys)], "relative_path string, size_bytes long"))
    recs = sorted((r.relative_path, r.candidate_compact) for r in f.where("is_informative and not is_template").collect())
    want = {
        (p, q) for i, (p, a) in enumerate(recs) for q, b in recs[i + 1 :]
        if a != b and a[0] == b[0] and abs(len(a) - len(b)) <= 4 and SequenceMatcher(None, a, b).ratio() >= 0.92
    }
    got = {(r.left, r.right) for r in audit.near_links(f).collect()}
    assert (f"d0000/{keys[0]}.pdf", f"d0001/{keys[1]}.pdf") in want and len(want) > 60 and got == want


def test_near_links_equal_all_pairs_of_many_words(spark):
    from difflib import SequenceMatcher

    rng = random.Random(12)
    pool = ["dialysis", "nurse", "anna", "maria", "de", "la", "b", "quist", "tolcamber", "wexford", "imelda"]
    names = {" ".join(["anna", *(rng.choice(pool) for _ in range(rng.randrange(7)))]) for _ in range(150)}
    names |= {" ".join(["anna", *(c for c in "bcdefghijklmn" if c != x)]) for x in "bcdefg"}  # more words than are looked up by three
    rows = [(f"d{k:03d}/{n}.pdf", rng.choice([0, 60, 90, 100])) for k, n in enumerate(sorted(names))]
    f = audit.file_features(spark.createDataFrame(rows, "relative_path string, size_bytes long"))
    recs = sorted((r for r in f.collect() if r.is_informative), key=lambda r: r.relative_path)
    want = set()
    for i, a in enumerate(recs):
        for b in recs[i + 1 :]:
            ca, cb, ta, tb = a.candidate_compact, b.candidate_compact, set(a.tokens), set(b.tokens)
            if ca == cb or ca[0] != cb[0] or abs(len(ca) - len(cb)) > 4:
                continue
            s = SequenceMatcher(None, ca, cb).ratio()
            ratio = 0 if 0 in (a.size_bytes, b.size_bytes) else min(a.size_bytes, b.size_bytes) / max(a.size_bytes, b.size_bytes)
            over, holds = len(ta & tb) / min(len(ta), len(tb)) >= 0.75, ca in cb or cb in ca
            if s >= 0.92 and (over or holds or ratio >= 0.7) or over and (s >= 0.84 or ratio >= 0.85 or holds):
                want.add((a.relative_path, b.relative_path))
    assert len(want) > 100 and {(r.left, r.right) for r in audit.near_links(f).collect()} == want


def test_common_names_and_occupations_make_no_pairs(spark):
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    names = [f"Wojciech {letters(9)}" for _ in range(1500)] + [f"Dialysis Technician {letters(6)} {letters(9)}" for _ in range(1500)]
    f = audit.file_features(spark.createDataFrame([(f"d{copy}/{n}.pdf", 100) for n in names for copy in range(3)], "relative_path string, size_bytes long"))
    people = audit.person_keys(f).cache()
    assert people.count() == len(set(names)) and audit.near_people(people, 4).count() < 1000  # of 2,248,500 pairs of a kind


# ---- store, uploads, settings

def test_merge_keeps_creation_and_is_idempotent(spark):
    s = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    one = store.merged(None, spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "k string, v int"), ["k"], s(1))
    two = store.merged(one, spark.createDataFrame([("b", 3), ("b", 3), ("c", 4)], "k string, v int"), ["k"], s(2))
    rows = lambda df: {(r.k, r.v, r.created_at.day, r.updated_at.day) for r in df.collect()}
    assert rows(two) == {("a", 1, 1, 1), ("b", 3, 1, 2), ("c", 4, 2, 2)}
    assert rows(store.merged(two, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"], s(2))) == rows(two)
    assert rows(store.merged(two, spark.createDataFrame([], "k string, v int"), ["k"], s(3))) == rows(two)


def test_table_versions(spark, tmp_path):
    t = store.Table(spark, str(tmp_path), "lists")
    with pytest.raises(ValueError, match="no table"):
        t.read()
    t.create("job string, n int")
    assert t.read().count() == 0
    t.replace(spark.createDataFrame([("j", 1), ("k", 2)], "job string, n int"))
    t.replace_groups(t.read().where("job = 'j'").withColumn("n", F.lit(9)), "job")
    assert {tuple(r) for r in t.read().collect()} == {("j", 9), ("k", 2)}
    t.replace_groups(t.read().limit(0), "job", spark.createDataFrame([("k",)], "job string"))
    assert {tuple(r) for r in t.read().collect()} == {("j", 9)}
    with pytest.raises(ZeroDivisionError):
        t.replace(t.read().select(1 / 0))
    assert t.read().count() == 1
    assert len([p for p in (tmp_path / "lists").iterdir() if p.name.startswith("v-")]) == 2
    with pytest.raises(ValueError, match="identifier"):
        store.Table(spark, str(tmp_path), "bad-name")


def test_a_merge_rewrites_only_the_parts_it_touches(spark, tmp_path):
    t = store.Table(spark, str(tmp_path), "people", key=("k",), parts=8)
    t.merge(spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int"), ["k"])
    before = t._state()["parts"]
    t.merge(spark.createDataFrame([("k3", -1), ("new", 7)], "k string, v int"), ["k"])
    after = t._state()["parts"]
    assert len(before) == 8 and 1 <= sum(before[p] != after[p] for p in after) <= 2
    rows = {r.k: r.v for r in t.read().collect()}
    assert len(rows) == 101 and rows["k3"] == -1 and rows["new"] == 7 and rows["k4"] == 4
    t.merge(spark.createDataFrame([], "k string, v int"), ["k"])
    assert t._state()["parts"] == after
    t.replace_groups(t.read().where("k = 'k5'").withColumn("v", F.lit(0)), "k", spark.createDataFrame([("k6",)], "k string"))
    rows = {r.k: r.v for r in store.Table(spark, str(tmp_path), "people", key=("k",), parts=3).read().collect()}
    assert len(rows) == 100 and rows["k5"] == 0 and "k6" not in rows
    with pytest.raises(ValueError):
        store.Table(spark, str(tmp_path), "both", ("v",), ("k",))


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from rolescope.session import checkpoint_root

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(cluster)


def test_stems_and_artifacts(spark):
    df = spark.createDataFrame([("b/x.pdf",), ("a/x.docx",), ("y.txt",)], "path string")
    assert {r.path for r in store.first_of_stem(df).collect()} == {"a/x.docx", "y.txt"}
    assert {r.path for r in store.first_of_stem(df, overwrite=True).collect()} == {"b/x.pdf", "y.txt"}
    ranked = spark.createDataFrame([("j", "r2", 2), ("j", "r1", 1), ("j", "r3", 3)], "job_id string, resume_id string, ranking_rank int")
    assert json.loads(store.ranking_artifact(ranked, 2).first().ranking) == [{"ranking_rank": 1, "resume_id": "r1"}, {"ranking_rank": 2, "resume_id": "r2"}]


def test_uploads(spark):
    rows = [("x/one.pdf", 10, None), ("two.exe", 10, None), ("", 10, None), ("e.txt", 0, None), ("big.txt", 11_000_000, None), ("!!.pdf", 5, None), ("z.docx", 5, " my id "), (None, None, None)]
    got = uploads.checked(spark.createDataFrame(rows, "filename string, size_bytes long, resume_id string"))
    assert [(r.resume_id, r.reject) for r in got.collect()] == [("one", None), ("two", "bad suffix"), (None, "no name"), ("e", "empty"), ("big", "too large"), (None, "no id"), ("my-id", None), (None, "no name")]
    event = uploads.upload_events(got, "/land", "2024-01-01 00:00:00").where("key = 'my-id'").first()
    assert json.loads(event.value) == {"resume_id": "my-id", "source_filename": "z.docx", "source_path": "/land/my-id.docx", "uploaded_at": "2024-01-01T00:00:00.000000Z"}
    assert uploads.rejected(got).count() == 6


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nA=1\nB = 'two' \n\nno\nC=x=y\n")
    values = settings.read_env_file(str(env))
    assert values == {"A": "1", "B": "two", "C": "x=y"} and settings.read_env_file(str(tmp_path / "none")) == {}
    assert settings.resolve("A", "d", values, {"A": "env"}) == "env" and settings.resolve("A", "d", values, {}) == "1" and settings.resolve("Z", "d", values, {}) == "d"
    assert settings.identifier("candidate_profiles") == "candidate_profiles"
    with pytest.raises(ValueError):
        settings.identifier("candidate-profiles")
    assert settings.suffix_list("pdf, .DOCX,,txt") == (".pdf", ".docx", ".txt")


def test_run_manifest(spark):
    df = spark.createDataFrame([("a", "persisted", None), ("b", "failed", "x"), ("c", "skipped", None)], "path string, status string, error string")
    assert tuple(quality.run_manifest(df).first()) == (3, 1, 1) and [r.path for r in quality.run_failures(df).collect()] == ["b"]
    assert tuple(quality.run_manifest(df.limit(0)).first()) == (0, 0, 0)
