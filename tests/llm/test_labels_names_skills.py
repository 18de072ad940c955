"""Label overlaps, skill mapping and name linking."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rolescope.llm import label_overlap, name_linking, skill_mapping
from rolescope.llm.folding import damerau, plain

LABELS = "label_id long, job_id string, resume_id string, label int, split string, source string, notes string"


def pairs(spark, rows):
    df = spark.createDataFrame([(i, j, r, 1, s, "x", None) for i, j, r, s in rows], LABELS)
    return {tuple(p) for p in label_overlap.overlapping_labels(df).collect()}


def test_overlaps_however_written(spark):
    rows = [
        (1, "clerk_jd_00000012", "cv-000000123-abcd", "train"), (2, " Clerk Jd 00000012", "CV-000000123-ABCD", "Val"), (3, "clerkjd12", "cv_123_abcd (2).pdf", "TEST "), (4, "clerk_dj_00000012", "cv-000000132-abcd", "validation"),
        (5, "clerk_jd_00000021", "cv-000000123-abcd", "test"), (6, "clerk_jd_00000012", "cv-000000123-abcd", None), (7, "clerk_jd_00000012", "cv-000000123-abcd", " "), (8, "clerk_jd_00000012", "cv-000000123-abcd", "holdout"),
        (9, "clerk_jd_00000012", "cv-000000123-wxyz", "test"), (10, None, "cv-000000123-abcd", "test"), (11, "clerk_jd_00000012", "", "test"), (None, "clerk_jd_00000012", "cv-000000123-abcd", "test"), (12, "clerk_jd_00000012", "cv-000000123-abdc - Copy", "train"), (13, "clerk_jd_00000012", "cv-000000123-abcd_final", "train"),
    ]
    # 12 has a swap in its check letters, 4 in its number: two slips are two ids
    assert pairs(spark, rows) == {(1, 2), (1, 3), (1, 4), (2, 12), (3, 12), (2, 13), (3, 13), (4, 13)}
    assert pairs(spark, []) == set() and pairs(spark, rows[:1]) == set()


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["clerk", "nurse", "pilot"]
    rows = []
    for k in range(400):
        job, cv, tail = rng.randrange(6), rng.randrange(12), "".join(rng.choice("ab") for _ in range(4))
        j, r = f"{words[job % 3]}_jd_{job:08d}", f"cv-{cv:09d}-{tail}"
        if rng.random() < 0.4:
            i = rng.randrange(len(r) - 1)
            r = rng.choice([r.upper(), r.replace("-", ""), r[:i] + r[i + 1] + r[i] + r[i + 2 :], r + "(1)", r.replace("0000", "")])
        rows.append((k, j, r, rng.choice(["train", "training", "val", "test", None])))
    want = set()
    known = [(i, label_overlap.SPLITS.get(s), label_overlap.fold_id(j) + "#" + label_overlap.fold_id(r)) for i, j, r, s in rows if s]
    for i, s, a in known:
        for k, t, b in known:
            if i < k and (s == "train") != (t == "train") and label_overlap.same_judgement(a, b):
                want.add((i, k))
    assert len(want) > 100 and pairs(spark, rows) == want


def test_index_finds_all_maximal_matches():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(5)) + "#" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(40)]
    index = label_overlap.FullTextIndex([t.encode() for t in texts])
    for query in ("abba#babbab", "aaaaa#bbbbbb", "#", "zz#zz", "ab#", "bab#ba"):
        c = query.index("#")
        stretch = (max(0, c - 1), min(len(query), c + 2))
        reach = {}
        for _, s, e, lo, hi in zip(*index.maximal_matches([query.encode()], [stretch]), strict=True):
            assert s <= stretch[0] and e >= stretch[1]
            for k in index.located(np.arange(lo, hi)).tolist():
                old = reach.get(k, (s, e))
                reach[k] = (min(old[0], s), max(old[1], e))
        want = {}
        for k, t in enumerate(texts):
            left = right = 0
            d = t.index("#")
            while left < min(c, d) and query[c - 1 - left] == t[d - 1 - left]:
                left += 1
            while c + 1 + right < len(query) and d + 1 + right < len(t) and query[c + 1 + right] == t[d + 1 + right]:
                right += 1
            if c - left <= stretch[0] and c + 1 + right >= stretch[1]:
                want[k] = (c - left, c + 1 + right)
        assert reach == want


def test_index_is_compressed_and_exact():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh0123456789#<") for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    index = label_overlap.FullTextIndex([t.encode() for t in texts])
    assert index.bytes_held() < 2.5 * sum(map(len, texts))
    joined = "\x01".join(texts)
    for query in ("a", "b#", "7<", "c0a", "hh", "zz"):
        codes = index.code[np.frombuffer(query.encode(), np.uint8)]
        lo, hi = np.array([0]), np.array([index.n])
        for c in codes[::-1]:
            lo, hi = (index.extend(np.array([max(c, 0)]), x) if c >= 0 else x * 0 for x in (lo, hi))
        assert hi[0] - lo[0] == sum(joined.startswith(query, k) for k in range(len(joined)))
        assert sorted(set(index.located(np.arange(lo[0], hi[0])).tolist())) == [k for k, t in enumerate(texts) if query in t]


def test_slips_in_numbers_that_letters_confirm(spark):
    rows = [
        (1, "clerk-0000123-wxyz", "cv-000451-abcd", "train"), (2, "clerk-0000132-wxyz", "cv-000451-abcd", "test"), (3, "clerk-0000123-wxyz", "cv-000415-abcd", "val"), (4, "clerk-000123-wxyz", "cv-00451-abcd", "val"),
        (5, "clerk-0000132-wxyz", "cv-000415-abcd", "test"), (6, "clerk-0000132-wxzy", "cv-000451-abcd", "test"), (7, "alice", "bob", "train"), (8, "Alice", "BOB", "test"), (9, "alise", "bob", "test"),
    ]
    # 6 has a slip in the number and in the letters of the job
    assert pairs(spark, rows) == {(1, 2), (1, 3), (1, 4), (1, 5), (7, 8)}


def test_routes_meet_every_slip():
    rng = random.Random(12)
    for _ in range(3000):
        n = rng.randrange(1, 8)
        a = "".join(rng.choice("0123456789") for _ in range(n))
        k = rng.randrange(n)
        b = rng.choice([a[:k] + a[k + 1 :], a[:k] + rng.choice("0123456789") + a[k:], a[:k] + rng.choice("0123456789") + a[k + 1 :], a[:k] + a[k + 1 : k + 2] + a[k : k + 1] + a[k + 2 :]])
        x, y = f"job7#cv{a}abcd", f"job7#cv{b}abcd"
        if b and label_overlap.same_judgement(x, y):
            assert {r for r, *_ in label_overlap.spellings(x, True)} & {r for r, *_ in label_overlap.spellings(y, False)}, (a, b)


def test_many_labels_of_one_job_without_check_letters(spark):
    """No route gathers the job: shards stay small, and the pairs are those of equal numbers."""
    df = spark.range(100_000).selectExpr("id as label_id", "'clerk_jd_7' as job_id", "concat('cv', cast(id % 70000 as string)) as resume_id", "1 as label", "if(id < 70000, 'train', 'test') as split", "'x' as source", "cast(null as string) as notes")
    routes = {}
    for k in range(2000):
        for route, *_ in label_overlap.spellings(f"clerkjd7#cv{k}", True):
            routes[route] = routes.get(route, 0) + 1
    assert max(routes.values()) == 1
    got = label_overlap.key_overlaps(df)
    assert got.agg({"train_labels": "sum"}).first()[0] == 30_000 and got.count() == 30_000
    letters = {}
    for k in range(20_000):
        for route, *_ in label_overlap.spellings(f"clerkjd7#cv{k}final", k % 2 > 0):
            letters[route] = letters.get(route, 0) + 1
    # letters that all ids share check nothing, yet only numbers that agree by half meet
    assert max(letters.values()) <= 1000


def test_overlap_report(spark):
    rows = [(1, "a_1", "cv-1-abcd", 1, "train", "x", None), (2, "a_1", "cv-1-abcd", 1, "test", "X ", None), (3, "a_1", "cv-1-abdc", 1, "test", "x", None), (4, "a_2", "cv-1-abcd", 1, "val", None, None)]
    got = {(r.split, r.source): (r.labels, r.overlapping, r.spelled_otherwise) for r in label_overlap.overlap_report(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {("test", "x"): (2, 2, 1), ("validation", None): (1, 0, 0)}


# ---- skills

CATALOG = [(1, "Archive Auditing", "a", ["ArcAud"]), (2, "Archive drafting", "a", []), (3, "Boiler drafting", "a", None), (4, "Kethloom", "t", [None, ""]), (5, "Kethlode", "t", []), (6, "Machine learning", "t", ["ML"])]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([*CATALOG, (None, "x", "x", []), (9, None, "x", [])], "skill_id int, skill_name string, category string, aliases array<string>")


VALUES = {
    "archive auditing": 1, "  ARCHIVE-Auditing;": 1, "ArchiveAuditing": 1, "auditing (archive)": 1, "5+ yrs Archive Auditing - expert": 1, "arcaud": 1, "Árchive Auditing": 1, "Arhcive Auditing": 1, "arch. audit.": 1, "auditing of archives": 1,
    "archivea uditing": 1, "archiveoauditing": 1, "boiler drafting and archive auditing": 1, "Kethloom v5": 4, "Kethloome": 4, "Kethlo": 0, "archive": 0, "boiler auditing": 0, "drafting": 0, "n/a": 0, "": 0, "??": 0, "deep ML work": 6, "html": 0, "falcon drafting": 0,
}


def test_values_map_to_the_entry_they_mean(spark, catalog):
    df = spark.createDataFrame([(v, "keep", 7) for v in VALUES] + [(None, "keep", 7)], "raw_value string, skill_name string, n int")
    got = {r.raw_value: r.skill_id for r in skill_mapping.map_values(df, catalog).collect()}
    assert got == {**VALUES, None: 0}
    assert {r.skill_id for r in skill_mapping.map_values(df, catalog.limit(0)).collect()} == {0}
    clash = skill_mapping.map_values(df.withColumnRenamed("n", "skill_id"), catalog)
    assert {r.raw_value: r.skill_id for r in clash.collect()} == got | {None: 0}


def test_blocks_of_entries_change_nothing(spark, catalog):
    df = spark.createDataFrame([(v,) for v in [*VALUES, None]], "raw_value string")
    assert len(list(skill_mapping.catalog_blocks(catalog, 2))) > 1
    got = {r.raw_value: r.skill_id for r in skill_mapping.map_values(df, catalog, block=2).collect()}
    # an abbreviation that two entries share is told apart only where both are in one block
    assert {v: k for v, k in got.items() if v is None or "arch. " not in v} == {v: k for v, k in (VALUES | {None: 0}).items() if v is None or "arch. " not in v}


def test_entries_of_different_blocks_are_weighed_as_in_one_list(spark):
    names = {1: "Zinc mining", 2: "Tin casting", 4: "Hotwire", 5: "Plastic boring", 6: "Plastics mixing", 7: "Gear honing", 8: "Gear boning", 9: "Cablework", 10: "Cableworm"}
    catalog = spark.createDataFrame([(k, n, []) for k, n in names.items()] + [(3, "Pressing", ["hot wire"])], "skill_id int, skill_name string, aliases array<string>")
    meant = {
        "Tin casting and zinc mining": [2, 1],  # of equally long mentions the first
        "h otwire": [4],  # a name before an alias of the same letters
        "boring of plastics": [0],  # a word of any entry stands for itself
        "gear xoning": [0],  # two entries are equally like
        "cab leworms": [10],  # equally like, one of them nearer by letters
        "falcon": [0], "": [0], None: [0],
    }
    df = spark.createDataFrame([(v,) for v in meant], "raw_value string")
    for block in (50_000, 1):
        assert {r.raw_value: r.skill_id for r in skill_mapping.map_values(df, catalog, block=block).collect()} == {v: k[0] for v, k in meant.items()}
        rows = sorted(skill_mapping.map_mentions(df, catalog, block=block).collect(), key=lambda r: r.place)
        assert {v: [r.skill_id for r in rows if r.raw_value == v] for v in meant} == meant


def test_all_mentions_that_no_longer_one_overlaps(spark, catalog):
    values = {"ML, archive auditing and boiler drafting": [6, 1, 3], "machine learning": [6], "archive drafting auditing": [2], "Arhcive Auditing": [1], "falcon": [0], None: [0], "boiler drafting; boiler drafting": [3]}
    df = spark.createDataFrame([(v, 9, 7) for v in values], "raw_value string, place int, skill_id int")
    for block in (50_000, 2):
        rows = sorted(skill_mapping.map_mentions(df, catalog, block=block).collect(), key=lambda r: r.place)
        got = {}
        for r in rows:
            got.setdefault(r.raw_value, []).append(r.skill_id)
        if block > 2:
            assert got == values
        assert got["machine learning"] == [6] and got[None] == [0]


def test_typed_values_are_distinct_and_not_blank(spark, catalog):
    jobs = spark.createDataFrame([("j", ["a", "a", None, " ", "\t"], None), ("j", ["a"], ["a", ""])], "job_id string, required_skills array<string>, preferred_skills array<string>")
    profiles = spark.createDataFrame([("r", ["b"]), ("s", None)], "resume_id string, skills array<string>")
    got = sorted(tuple(r) for r in skill_mapping.typed_values(jobs, profiles).collect())
    assert got == [("j", "job_descriptions.preferred_skills", "a"), ("j", "job_descriptions.required_skills", "a"), ("r", "candidate_profiles.skills", "b")]
    mapped = skill_mapping.mapped_skills(jobs, profiles, catalog)
    assert {r.raw_value: r.records for r in skill_mapping.unmatched_report(mapped).where("field like 'cand%'").collect()} == {"b": 1}
    assert skill_mapping.usage_report(mapped, catalog.where("skill_id = 1 and skill_name is not null")).first().records == 0


def test_damerau_equals_its_definition():
    rng = random.Random(1)

    def slow(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        assert damerau(a, b, 3) == min(slow(a, b), 4)
    assert plain("Ærøskøbing Łódź ﬁn") == "aeroskobing lodz fin"


# ---- names

NICK = "nickname string, given_name string"
RECORDS = "id string, scope string, name string, is_file boolean, node string"


def linked(spark, rows, nick=(("Bob", "Robert"), ("Rob", "Robert"), ("Alex", "Alexander"), ("Alex", "Alexandra"))):
    df = spark.createDataFrame([(i, s, n, f, "clash") for i, s, n, f in rows], RECORDS)
    people = name_linking.people(df, spark.createDataFrame([*nick, (None, "x")], NICK))
    groups = {}
    for r in people.collect():
        groups.setdefault(r.person, set()).add(r.id)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_variants_of_one_person(spark):
    rows = [
        ("a", "f1", "Robert Falstackley", False), ("b", "f1", "FALSTACKLEY, BOB, PMP", False), ("c", "f1", "Dr. Robert X. Fal-Stackley (M.Sc.)", False), ("d", "f1", "r falstackley", True), ("e", "f1", "Róbert Fals tackley", False),
        ("f", "f1", "Robert Falstackely", False), ("g", "f2", "Robert Falstackley", False), ("h", "f1", "Hanne Falstackley", False), ("i", "f1", None, False), ("j", "f1", " ", True), ("k", "f1", "Robert", False), ("l", "f1", "falstackley", True), ("m", None, "Robert Falstackley", False), ("n", None, "Robert Falstackley", False),
    ]
    # c shows a hyphen, e a blank inside the family name
    got = linked(spark, rows)
    assert got == {frozenset("abcdf")} or got == {frozenset("abcdef")}


def test_an_initial_never_ties_two_people(spark):
    rows = [("a", "f", "Sigrid Norlomarsh", False), ("b", "f", "Stefan Norlomarsh", False), ("c", "f", "S. Norlomarsh", False), ("d", "f", "Norlomarsh S", True), ("e", "f", "Sigrid Norlomarsh", True), ("x", "f", "T. Quimbury", False), ("y", "f", "Quimbury, T.", True), ("z", "f", "Tamsin Quimbury", False)]
    assert linked(spark, rows) == {frozenset("ae"), frozenset("cd"), frozenset("xyz")}


def test_middle_names_tell_people_apart(spark):
    rows = [("a", "f", "Robert Kwame Ravkiford", False), ("b", "f", "Robert Eun Ravkiford", False), ("c", "f", "Robert K. Ravkiford", False)]
    assert linked(spark, rows) == {frozenset("ac")}


def test_file_words_are_no_names(spark):
    rows = [(f"n{k}", f"s{k}", f"night auditor {g} {f}", True) for k, (g, f) in enumerate([("ann", "leegard"), ("ben", "oakwick"), ("cy", "elmford")])] + [("p", "s0", "Ann Leegard", False), ("q", "s0", "night auditor ben leegard", True)]
    assert linked(spark, rows) == {frozenset({"n0", "p"})}
    assert linked(spark, []) == set()


def test_family_names_of_many_folders_stay(spark):
    rows = [("a", "s0", "devika bropelheim", True), ("b", "s0", "d bropelheim", True), ("c", "s1", "anna bropelheim", True), ("d", "s2", "anna zofia bropelheim", True), ("e", "s3", "zofia anna bropelheim", True)]
    rows += [("f", "s3", "anna bropelheim", True), ("g", "s4", "Anna Leegard", False), ("h", "s5", "Zofia Oakwick", False), ("i", "s6", "Devika Elmford", False)]
    assert linked(spark, rows) == {frozenset("ab")}


def test_file_words_leave_names_of_one_part_alone(spark):
    people = [("ann", "leegard"), ("ben", "oakwick"), ("cy", "elmford")]
    rows = [(f"n{k}", f"s{k}", f"night auditor {g} {f}", True) for k, (g, f) in enumerate(people)] + [(f"p{k}", f"s{k}", f"{g} {f}", False) for k, (g, f) in enumerate(people)]
    rows += [("x", "s9", "night auditor leegard", True), ("y", "s9", "night auditor leegard", True), ("z", "s9", "night auditor", True), ("w", "s9", "auditor night", True)]
    assert linked(spark, rows) == {frozenset({f"n{k}", f"p{k}"}) for k in range(3)} | {frozenset("xy")}


def test_short_family_names_link(spark):
    rows = [
        ("a", "f", "Tom Lee", False), ("b", "f", "Thomas Lee", False), ("c", "f", "LEE, THOMAS", True), ("d", "f", "lee tom", True), ("e", "f", "Jennifer Lee", False), ("g", "f", "Jenny Lee", False), ("h", "f", "A. Lee", False), ("i", "f", "Anna Lee", False),
        ("j", "f", "Kwame Kim", False), ("k", "f", "kwame kmi", True), ("l", "f", "Grete Wu", False), ("m", "f", "G Wu", True), ("n", "f", "Grete Ng", False), ("o", "f", "Tom Leigh", False), ("p", "f", "Jennifer Fox", False), ("q", "f", "Thomas Kim", False),
    ]
    assert linked(spark, rows, (("Tom", "Thomas"), ("Jenny", "Jennifer"))) == {frozenset("abcd"), frozenset("eg"), frozenset("hi"), frozenset("jk"), frozenset("lm")}


def test_large_blocks_are_parted_without_losing_links(spark):
    rng = random.Random(17)
    given, family = "robert hanne sigrid tomas maria renate hubert stefan".split(), "falstackley norlomarsh fallstockle falsteckley norlamersh".split()
    rows = []
    for k in range(160):
        g, f = rng.choice(given), rng.choice(family)
        i = rng.randrange(len(f) - 1)
        f = rng.choice([f, f, f[:i] + f[i + 1] + f[i] + f[i + 2 :], f[:i] + f[i + 1 :]])
        rows.append((f"r{k:03d}", "f", rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{f} {g}"]), k % 2 > 0))
    df = spark.createDataFrame([(*r, "clash") for r in rows], RECORDS)
    nick = spark.createDataFrame([("Bob", "Robert")], NICK)
    whole = {(r.id, r.person) for r in name_linking.people(df, nick, 10**6).collect()}
    assert {(r.id, r.person) for r in name_linking.people(df, nick, 2).collect()} == whole and len({p for _, p in whole}) < 60


def test_spellings_near_meet():
    rng = random.Random(3)
    compare = name_linking.Comparer(())
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9)))
        b = a
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(b))
            b = rng.choice([b[:i] + b[i + 1 :], b[:i] + rng.choice("abcd") + b[i:], b[:i] + b[i + 1 : i + 2] + b[i : i + 1] + b[i + 2 :]])
        if len(b) > 3 and compare.family(a, b):
            assert name_linking.spellings_near(a) & name_linking.spellings_near(b), (a, b)


def test_links_do_not_change_with_the_number_of_folders(spark):
    rows = [("a", "s0", "devika bropelheim", True), ("b", "s0", "d bropelheim", True), ("c", "s1", "night auditor ann leegard", True), ("d", "s1", "Ann Leegard", False), ("e", "s2", "Tom Lee", False), ("g", "s2", "lee tom", True)]
    rows += [(f"x{k}", f"t{k}", f"night auditor {g} {f}", True) for k, (g, f) in enumerate([("ben", "oakwick"), ("cy", "elmford"), ("eve", "quimbury")])] + [(f"y{k}", f"u{k}", n, False) for k, n in enumerate(("Ben Oakwick", "Cy Elmford", "Eve Quimbury"))]
    few = linked(spark, rows)
    more = rows + [(f"m{k}", f"v{k}", ("devika bropelheim", "ann leegard", "Tom Lee")[k % 3], k % 2 > 0) for k in range(1000)]
    assert linked(spark, more) == few == {frozenset("ab"), frozenset("cd"), frozenset("eg")}


def test_jaro_winkler_known_values():
    assert round(name_linking.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(name_linking.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert name_linking.jaro_winkler("", "a") == 0.0 and name_linking.jaro_winkler("abc", "xyz") == 0.0


def test_records_of_both_tables(spark):
    profiles = spark.createDataFrame([("r1", "data/raw/f1/a.pdf", "Old Name", "2024-01-01"), ("r1", "data/raw/f1/a.pdf", "Ann Leegard", "2024-02-01"), ("r2", None, "Ann Leegard", "2024-02-01")], "resume_id string, source_path string, name string, updated_at string")
    files = spark.createDataFrame([("x1", "f1/LeegardAnn.pdf", "leegardann", "CV LeegardAnn", "2024"), ("x2", "f1/scan.pdf", "", "scan", "2024"), ("x3", "f2/Ann Leegard.pdf", "ann leegard", "Ann Leegard", "2024"), ("x1", "f1/LeegardAnn.pdf", "leegardann", "CV LeegardAnn", "2024")], "file_id string, relative_path string, candidate_key string, stem string, modified_at string")
    nick = spark.createDataFrame([], NICK)
    got = name_linking.linked_pairs(name_linking.link_applicants(profiles, files, nick)).collect()
    assert [tuple(r) for r in got] == [("r1", "x1")]
