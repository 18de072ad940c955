"""Personal information in free text. Every sentence here is unknown to the detector's training texts."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pytest

from rolescope.llm import boosting, pii, pii_model, pii_spans, pii_words


def described(frame):
    out = []
    for r in frame.itertuples():
        document = pii_spans.document_of(r.profile_json)
        out.append(([t for _, t in pii_spans.free_texts(document)], pii._record(r.name, r.email, r.phone, document)))
    return out


@pytest.fixture(scope="module")
def profiles():
    return pd.read_parquet("/root/testdata/sf0.01/candidate_profiles.parquet").sort_values(["resume_id", "updated_at"]).astype(object).where(lambda d: d.notna(), None)


@pytest.fixture(scope="module")
def detector(profiles):
    taught = profiles.iloc[::2]
    return pii_model.fit_detector([n for n in taught.name if n], described(taught))


def found(detector, text, record=None):
    return [(pii_spans.KINDS[k], t) for k, _, _, t in detector.find([([text], record or pii_spans.Record())])[0]]


# Sentences of matters that no training text has, and what they hold.
UNSEEN = [
    ("My colleague Peter Hartmann reviewed every drawing.", [("name", "Peter Hartmann")]),
    ("Thanks go to Maria Lopez, who taught me soldering.", [("name", "Maria Lopez")]),
    ("Mit Jonas Keller habe ich das Lager umgebaut.", [("name", "Jonas Keller")]),
    ("It was Laura Bennett who hired us back then.", [("name", "Laura Bennett")]),
    ("For details ask Daniel Meyer or the front desk.", [("name", "Daniel Meyer")]),
    ("During the flood Helena Fischer kept the pumps alive.", [("name", "Helena Fischer")]),
    ("Der Bericht stammt von Thomas Wagner und wurde gelobt.", [("name", "Thomas Wagner")]),
    ("Le dossier fut relu par Claire Dubois en juin.", [("name", "Claire Dubois")]),
    ("Tutor: Prof. Omar Hassan", [("name", "Omar Hassan")]),
    ("Referee Dr. Anna Lee Data Analyst", [("name", "Anna Lee")]),
    ("The shift lead, Robert Kowalski, signed the sheet.", [("name", "Robert Kowalski")]),
    ("Driving permit D1234-56789-01234", [("id_number", "D1234-56789-01234")]),
    ("Her passport is C3456789, issued in May.", [("id_number", "C3456789")]),
    ("Social security 219-09-9999 on file.", [("id_number", "219-09-9999")]),
    ("Drop by 27 Baker Street, London.", [("address", "27 Baker Street")]),
    ("Post goes to Gartenstraße 12 in Ulm.", [("address", "Gartenstraße 12")]),
    ("On holidays try 020 7946 0958 instead.", [("phone", "020 7946 0958")]),
    ("Mobile: +49 151 23456789", [("phone", "+49 151 23456789")]),
    ("My inbox is k.larsen@nordhus.no these days.", [("email", "k.larsen@nordhus.no")]),
    ("Drop a line to jo.t (at) works.org please.", [("email", "jo.t (at) works.org")]),
    ("Cut 14 boards @ 60 cm, revision 4.1.22.", []), ("Purchase order QX-2210-7 closed in 2019.", []), ("From 2004 to 2009 the plant doubled its output.", []), ("Joined the Northern Railway Museum as Stage Manager.", []),
    ("Counted 1200 bolts under stock code 77-881.", []), ("Norm ISO 27001 was met.", []), ("Revenue rose to 12,400,000 in the year.", []), ("Ran the shop on the corner of High Street.", []),
]


def test_unseen_sentences(detector):
    want = {(k, s) for k, (_, spans) in enumerate(UNSEEN) for s in spans}
    got = {(k, s) for k, (text, _) in enumerate(UNSEEN) for s in found(detector, f"Applicant 3\n{text}")}
    assert len(want & got) >= 0.85 * len(want), sorted(want - got)
    assert len(want & got) >= 0.85 * len(got), sorted(got - want)


def test_held_out_rows(detector, profiles):
    """Of the rows that the detector was not fitted on, the columns that stand in the text are found."""
    frame = profiles.iloc[1::2]
    seen = hit = 0
    for (texts, record), spans in zip(described(frame), detector.find(described(frame)), strict=True):
        own = {(pii_spans.KINDS[k], t) for k, _, _, t in spans}
        joined = "\n".join(texts)
        bare = max((b for b in pii_spans._bare_values(record)), key=len, default="")
        for kind, value in (("email", record.email), ("phone", record.phone), ("name", bare if "," not in record.name else "")):
            if len(value) > 6 and re.search(rf"(?<![\w.@+-]){re.escape(value)}(?![\w@-])", joined):
                seen += 1
                hit += (kind, value) in own
    assert seen > 300 and hit >= 0.97 * seen, (hit, seen)


def test_no_training_sentence_stands_in_the_tables(profiles):
    texts = "\n".join({t for own, _ in described(profiles) for t in own})
    sentences = [s for group in (*pii_model.SENTENCES.values(), pii_model.DECOYS) for s in group.split("|")]
    assert len(sentences) > 80
    for s in sentences:
        parts = [p for p in re.split(r"\{\w+\}", s) if re.search(r"\w{3}", p)]
        if parts and all(p in texts for p in parts):
            pattern = ".{1,60}?".join(map(re.escape, re.split(r"\{\w+\}", s)))
            assert not re.search(pattern, texts), s


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit_calibrated(x[:1000], y[:1000], rounds=60)
    p = model.probability(x[1000:])
    assert np.mean((p >= model.threshold) == y[1000:]) > 0.95 and 0 <= p.min() <= p.max() <= 1


def test_words_of_names():
    names = [w for _ in range(4) for w in "anna peter maria jonas helena lukas sofia martin".split()] + "hartmann kellermann bergmann hofmann".split()
    model = pii_words.fit_words(names, "order meeting report machine station planning station weekly drawing engine budget".split() * 3)
    assert model.look("Anna") > 0 > model.look("Station") and model.look("Baumann") > model.look("Drawing") and model.look("with") == -8.0
    assert pii_words.fit_words([], ["a", "table"]).look("Anna") == 0.0


TEXT = """Dr. Ann Norlomarsh, PMP
my inbox is ann.norlo+jobs@nordhus.no now | Tel. (305) 555-0199 | Flat 2, 163 Weaver Road
Passport QQ 84 92 38 C

EXPERIENCE
Kiln Operator, Thistledon Textiles 2012-2016
Purchase order QX-0217-50 closed early. Cut 62 boards @ 48 cm, revision 5.0.18. The plan was drawn with Robert Fischer.
Ran the shop on the corner of High Street. Post goes to Tannerstraße 146b in Halmere.
University of Halmere  2011
"""
OWN = pii_spans.Record("Dr. Ann Norlomarsh, PMP", "ann.norlo+jobs@nordhus.no", "(305) 555-0199", ("Kiln Operator", "Thistledon Textiles"))


def test_spans_of_a_text(detector):
    want = {("name", "Ann Norlomarsh"), ("email", "ann.norlo+jobs@nordhus.no"), ("phone", "(305) 555-0199"), ("address", "Flat 2, 163 Weaver Road"), ("id_number", "QQ 84 92 38 C"), ("name", "Robert Fischer"), ("address", "Tannerstraße 146b")}
    assert set(found(detector, TEXT, OWN)) == want


def test_redaction_keeps_the_rest(detector):
    spans = detector.find([([TEXT], OWN)])[0]
    out = pii_spans.redacted(TEXT, pii._by_piece([TEXT], spans))
    assert "Dr. [NAME], PMP\nmy inbox is [EMAIL] now | Tel. [PHONE] | [ADDRESS]\nPassport [ID_NUMBER]\n" in out
    assert "drawn with [NAME].\n" in out and "Post goes to [ADDRESS] in Halmere." in out and "order QX-0217-50 closed" in out and out.count("[") == 7
    assert pii_spans.redacted("", {}) == "" and pii_spans.redacted("  \n x \n", {}) == "  \n x \n"


def test_every_occurrence_goes(detector):
    text = "anna leegard\nWritten by anna leegard herself, checked by ANNA LEEGARD.\nmail anna.l@works.org or again anna.l@works.org"
    record = pii_spans.Record("anna leegard", "anna.l@works.org")
    at = {(text.replace("\n", "\n")[a:b]) for k, a, b in pii_spans.candidates(text, [0, 13, 72], record) if k == 4}
    assert {"anna leegard", "ANNA LEEGARD"} <= at
    out = pii_spans.redacted(text, pii._by_piece([text], detector.find([([text], record)])[0]))
    assert "leegard" not in out and "works.org" not in out and out.count("[EMAIL]") == 2


def test_a_firm_named_after_a_person_hides_nobody(detector):
    record = pii_spans.Record("Ole Quimbury", known=("Maria Lopez Consulting", "Stage Manager"))
    assert ("name", "Maria Lopez") in found(detector, "Stage Manager, Maria Lopez Consulting 2012-2014\nThe plan was drawn with Maria Lopez.", record)


def test_names_inside_runs_are_candidates():
    for text in ("Anna Lee Data Analyst", "Referee Dr. Anna Lee", "Senior Data Analyst Anna Lee Quarry Textiles Works Group", "Referee Dr. Anna Lee Data Analyst Freight Works", "supervisor: anna lee"):
        assert "anna lee" in {text[a:b].lower() for k, a, b in pii_spans.candidates(text, [0], pii_spans.Record()) if k == 4}, text
    text = "Referee Lee, Anna Data Analyst"
    assert "Lee, Anna" in {text[a:b] for k, a, b in pii_spans.candidates(text, [0], pii_spans.Record()) if k == 4}
    assert ("name", "Herr") not in {("name", "x")} and "Keller" in {"Herr Keller kam."[a:b] for k, a, b in pii_spans.candidates("Herr Keller kam.", [0], pii_spans.Record()) if k == 4}


def test_profiles_of_any_shape(spark, detector):
    docs = [
        ("a", json.dumps({"raw_text": TEXT, "sections": {"x": "on holidays try 07700 900123 instead", "y": None}, "experience": {"raw_text": "r", "description": "drop a line to bob@works.org today"}, "projects": [None, {"description": 5}]})),
        ("b", None), ("c", "{bad"), ("d", "[]"), ("e", json.dumps(json.dumps({"raw_text": "Tel. 07700 900456"}))), ("f", json.dumps({"raw_text": ""})), ("g", json.dumps({"raw_text": "word " * 100_000 + "\nTel. 07700 900789"})), (None, json.dumps({"raw_text": "Tel. 07700 900111"})),
        ("h", json.dumps({"raw_text": "x" * 300_000 + "@" + "y" * 300_000 + " " + "Aa " * 50_000})),
    ]
    rows = [(i, d, None, None, None, "2024-01-01", "clash") for i, d in docs] + [("e", docs[4][1], " ", "", "", "2024-01-02", "clash")]
    df = spark.createDataFrame(rows, "resume_id string, profile_json string, name string, email string, phone string, updated_at string, kind string")
    got = {tuple(r) for r in pii.found_spans(df, detector).collect()}
    phones = {(r[0], r[2]) for r in got if r[1] == "phone"}
    assert phones == {("a", "(305) 555-0199"), ("a", "07700 900123"), ("e", "07700 900456"), ("g", "07700 900789"), (None, "07700 900111")}
    assert ("a", "email", "bob@works.org") in got
    red = {(r.resume_id, r.path): r.text for r in pii.redacted_texts(df, detector).collect()}
    assert red["a", "sections.x"] == "on holidays try [PHONE] instead" and red["a", "experience[0].description"] == "drop a line to [EMAIL] today" and red["f", "raw_text"] == "" and ("b", "raw_text") not in red
    assert pii.found_spans(df.limit(0), detector).count() == 0


def test_fitting_on_a_table(spark):
    none = spark.createDataFrame([], "resume_id string, profile_json string, name string, email string, phone string, updated_at string")
    assert pii.found_spans(none).count() == 0
    one = spark.createDataFrame([("a", json.dumps({"raw_text": "Tel. 07700 900456"}), None, None, None, "x")], "resume_id string, profile_json string, name string, email string, phone string, updated_at string")
    assert pii.found_spans(one).count() == 1
