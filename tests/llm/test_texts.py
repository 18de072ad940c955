"""Encoding, evaluation leakage and reading levels."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from rolescope.llm import corpus_encoding, eval_leakage, reading_level

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t) if t is not None else None, "clash") for k, t in enumerate(texts)], DOCS)


# ---- encoding

ODD = ["", None, " ", "\n\n \t", "hello world", "don't we'll I'm", "naïve café – ünïcode 中文字 🙂🙂", "a" * 5000, "x1y2" * 20_000, ("word " * 30_000), "12345678901234567890 " * 9000, "<|endoftext|> as text", "tab\tand\r\nline  end   ", "é ​   nbsp"]


def test_ids_equal_the_plain_library(spark):
    enc = corpus_encoding.encoding(f"{corpus_encoding.TOKENIZER_DIR}/{corpus_encoding.RANKS}")
    got = {r.doc_id: r.ids for r in corpus_encoding.encode(documents(spark, ODD)).collect()}
    for k, t in enumerate(ODD):
        assert got[k] == (enc.encode_ordinary(t) if t else []), k
    assert corpus_encoding.encode(documents(spark, ODD).limit(0)).count() == 0


def test_splits_of_long_texts_change_nothing():
    enc = corpus_encoding.encoding(f"{corpus_encoding.TOKENIZER_DIR}/{corpus_encoding.RANKS}")
    rng = random.Random(2)
    alphabet = list("aZ1 9'!\n\t é中'  ")
    for size in (3, 7, 64):
        for _ in range(60):
            t = "".join(rng.choice(alphabet) for _ in range(300))
            assert "".join(corpus_encoding.safe_pieces(t, size)) == t
            ids = np.concatenate([np.empty(0, np.int32), *corpus_encoding.encode_bytes(enc, t.encode(), size)]).tolist()
            assert ids == enc.encode_ordinary(t)


def test_round_trip_and_profile(spark):
    d = documents(spark, ODD)
    assert tuple(corpus_encoding.round_trip(d).first()) == (len(ODD), 0)
    r = corpus_encoding.token_profile(corpus_encoding.encode(d), d).first()
    assert r.documents == len(ODD) and r.tokens > 1000
    enc = corpus_encoding.encoding(f"{corpus_encoding.TOKENIZER_DIR}/{corpus_encoding.RANKS}")
    bad = b"ok \xff\xfe end"
    ids = np.concatenate(corpus_encoding.encode_bytes(enc, bad)).tolist()
    assert enc.decode_bytes(ids) == bad
    half = spark.createDataFrame([(1, enc.encode_ordinary("中")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert [bytes(r.raw) if r.raw is not None else None for r in corpus_encoding.decode(half).collect()] == [enc.decode_bytes(enc.encode_ordinary("中")[:1]), None]


# ---- leakage

def puzzle(rng, n=90):
    nouns, verbs = "maps bolts kilns tiles flasks crates pallets permits ledgers ballots".split(), "repairs sends weighs owes leaks keeps".split()
    return [rng.choice([*nouns, *verbs, "the", "a", "of", "until", "each", str(rng.randrange(99)), f"name{rng.randrange(40)}"]) for _ in range(n)]


def brute(items, texts, passage=20):
    out = set()
    for d, t in enumerate(texts):
        w = eval_leakage.words(t)
        for i, x in items:
            own = eval_leakage.words(x)
            joins = eval_leakage.placed([a + b for a, b in zip(own, own[1:], strict=False)])
            if eval_leakage.longest_passage(eval_leakage.placed(own), w, joins) >= passage:
                out.add((d, i))
    return out


def leak_cases(seed=5):
    rng = random.Random(seed)
    items = [(i, " ".join(puzzle(rng))) for i in range(1, 31)]
    fill = lambda n: " ".join(rng.choice("people should manage weekly reports with care the of each until".split()) for _ in range(n))
    texts = [None, "", " ", fill(400)]
    for _ in range(160):
        i, t = rng.choice(items)
        w = t.split()
        n = rng.choice([8, 12, 16, 20, 24, 30, 60])
        a = rng.randrange(len(w) - n + 1)
        part = w[a : a + n]
        style = rng.randrange(5)
        if style == 1:
            for k in range(6, len(part) - 3, 7):
                part[k] = rng.choice(["other", part[k] + "s"])
        elif style == 2:
            part = [p for k, p in enumerate(part) if k % 9 != 5]
        elif style == 3:
            part = [x for k, p in enumerate(part) for x in ((p, "old") if k % 8 == 4 else (p,))]
        text = " ".join(part)
        if style == 4:
            text = text.upper().replace(" ", "  ").replace("E", "Е", 3).replace("MAPS", "MA-\n> PS") + "!"
        texts.append(fill(rng.randrange(60)) + ".\n\n" + text + "\n" + fill(rng.randrange(60)))
    return items, texts


def test_leaks_equal_brute_force(spark):
    items, texts = leak_cases()
    table = spark.createDataFrame([(i, t, "b", "ans") for i, t in items] + [(99, None, "b", ""), (98, "too short", "b", "")], "item_id long, text string, benchmark string, answer string")
    got = {(r.doc_id, r.item_id) for r in eval_leakage.leaked_items(documents(spark, texts), table).collect()}
    want = brute(items, texts)
    assert len(want) > 60 and got <= want and len(got) >= 0.97 * len(want)
    in_blocks = {(r.doc_id, r.item_id) for r in eval_leakage.leaked_items(documents(spark, texts), table, block_chars=4000).collect()}
    assert in_blocks == got
    assert eval_leakage.leaked_items(documents(spark, texts), table.limit(0)).count() == 0
    assert eval_leakage.leaked_items(documents(spark, texts).limit(0), table).count() == 0
    report = {r.item_id: r.documents for r in eval_leakage.leaked_report(documents(spark, texts), table).collect()}
    assert report[99] == 0 and sum(report.values()) == len(got)


def altered(rng, own, edits):
    """Window with ``edits`` altered words, two equal ones between."""
    w, at = list(own), [2, 5, 8, 11, 14, 17]
    for p in sorted(rng.sample(at, edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            w[p] = -1
        elif kind == 1:
            del w[p]
        else:
            w.insert(p, -1)
    return w


@pytest.mark.parametrize("edits", range(7))
def test_sampling_recall_over_windows(edits):
    """Share of windows with so many altered words that meet their item's window in some table."""
    items, _ = leak_cases(9)
    index = eval_leakage.build_index(tuple(items))
    unknown = len(index.vocabulary)
    rng = random.Random(4)
    met = 0
    for _ in range(200):
        k = rng.randrange(len(index.windows))
        w = [unknown if x < 0 else x for x in altered(rng, index.windows[k].tolist(), edits)]
        w = (w + [unknown] * 20)[:20]
        hit = False
        for r in range(len(index.bits)):
            out = eval_leakage.walk(np.array([w], np.int32), index.bits[r], 40)
            for s, sample in enumerate(index.samples[r]):
                keys, order = index.tables[r * len(index.samples[r]) + s]
                key = eval_leakage._hash(out[sample].T)
                hit |= k in order[np.searchsorted(keys, key[0], "left") : np.searchsorted(keys, key[0], "right")]
        met += hit
    assert met / 200 >= 0.95, met / 200


def test_words_run_together_or_parted_by_marks(spark):
    rng = random.Random(8)
    item = puzzle(rng, 22)
    item[9:13] = ["well", "known", "gamma", "delta"]
    clean, hyphen = " ".join(item), " ".join(item).replace("well known", "well-known")
    dash = clean.replace("gamma delta", "gamma—delta")
    both = clean.replace("well known", "wellknown").replace("gamma delta", "gamma/delta")
    for stored, texts in ((clean, [hyphen, dash, both]), (hyphen, [clean, dash.replace("well known", "well-known")]), (dash, [clean, hyphen])):
        table = spark.createDataFrame([(1, stored)], "item_id long, text string")
        assert {r.doc_id for r in eval_leakage.leaked_items(documents(spark, texts), table).collect()} == set(range(len(texts))), stored


def test_passages_with_every_third_word_altered(spark):
    """Twenty words of which six are altered, at the very end of a document too."""
    rng = random.Random(21)
    items = [(i, " ".join(puzzle(rng))) for i in range(1, 21)]
    texts = []
    for k in range(60):
        own = items[k % 20][1].split()
        at = rng.randrange(len(own) - 20)
        part = [f"x{rng.randrange(99)}" if w == -1 else w for w in altered(rng, own[at : at + 20], 6)]
        texts.append("people manage weekly reports. " + " ".join(part) + (" and so on." if k % 2 else ""))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in eval_leakage.leaked_items(documents(spark, texts), table).collect()}
    want = brute(items, texts)
    assert len(want) > 30 and got <= want and len(got) >= 0.95 * len(want)


def test_words_fold_layout():
    assert eval_leakage.words("The Leap-\n> year,  AUDIT's «ﬁne» а­b") == ["the", "leapyear", "audits", "fine", "ab"]
    assert eval_leakage.words(None) == [] and eval_leakage.words("—  !") == []


def test_one_long_text(spark):
    items, _ = leak_cases(3)
    text = "filler words here " * 60_000 + items[0][1] + " more text" * 60_000
    table = spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in eval_leakage.leaked_items(documents(spark, [text]), table).collect()] == [(0, 1)]


def test_near_windows_is_edit_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (60, 8)), rng.integers(0, 3, (60, 11))
    got = eval_leakage.near_windows(a, b, 3)

    def slow(x, y):
        best = 99
        for n in range(len(x) - 3, len(x) + 4):
            d = list(range(n + 1))
            for i, p in enumerate(x, 1):
                new = [i]
                for j in range(1, n + 1):
                    new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (p != y[j - 1])))
                d = new
            best = min(best, d[n])
        return best

    for x, y, g in zip(a, b, got, strict=True):
        s = slow(x, y)
        assert g == s if s <= 3 else g >= 3


# ---- reading levels

def test_levels_of_graded_passages(data):
    anchors = pd.read_parquet(f"{data}/reading_anchors.parquet")
    x, y = reading_level.text_features(list(anchors.text)), anchors.band.to_numpy()
    right = sum(reading_level.fit(x[np.arange(len(y)) != k], y[np.arange(len(y)) != k]).band(x[k : k + 1])[0] == y[k] for k in range(len(y)))
    assert right / len(y) >= 0.9


def test_features_equal_a_plain_count():
    import re

    texts = ["", "One two three. Four five six!", "Because the RELATIONSHIP ended, Although he may be able to see the management which agreed. an activity", "Extraordinarily complicated considerations, notwithstanding; yes?", "a\nb", "1 2 3", "ünïcode wörds héré. Ok"]
    got = reading_level.text_features(texts)
    for t, row in zip(texts, got, strict=True):
        words = re.findall(r"[^\W\d_]+", t)
        if not words:
            assert not row.any()
            continue
        sizes = [len(w) for w in words]
        ends = max(1, len(re.findall(r"[.!?;](?=\s|$)", t)))
        assert row[0] == pytest.approx(np.log(len(words) / ends)) and row[1] == pytest.approx(np.mean(sizes)) and row[3] == pytest.approx(np.mean([s >= 7 for s in sizes]))
        low = [w.lower() for w in words]
        assert row[7] == pytest.approx(sum(w in reading_level._CLAUSE for w in low) / ends) and row[8] == pytest.approx(np.mean([w in reading_level._FUNCTION for w in low]))
        runs = [len(re.findall("[aeiouy]+", w)) for w in low]
        assert row[9] == pytest.approx(np.mean([r >= 3 for r in runs])) and row[10] == pytest.approx(np.mean([r >= 4 for r in runs])) and row[11] == pytest.approx(np.mean([s <= 4 for s in sizes]))
        assert row[12] == pytest.approx(np.mean([len(w.encode()) >= 7 and (w[-4:] in reading_level._DERIVED or w[-3:] in reading_level._DERIVED_SHORT) for w in low]))
    whole = reading_level.text_features(["".join(texts)])
    assert whole.shape == (1, len(reading_level.FEATURES))


def test_isotonic_regression():
    x, y = reading_level.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 2, 5]))
    assert np.all(np.diff(y) >= 0) and np.interp(3, x, y) == pytest.approx(7 / 3)


def test_bands(spark, data):
    anchors = spark.read.parquet(f"{data}/reading_anchors.parquet")
    easy, hard = anchors.where("band = 1").first().text, anchors.where("band = 5").first().text
    rows = [(1, easy, "en", 700), (2, hard, "en", 700), (3, hard, "de", 700), (4, hard, "en", 599), (5, None, "en", 700), (6, "", "en", 700), (7, "123 !!", "en", 700), (8, hard * 300, "en", 10**6), (9, hard, None, 700), (10, hard, "en", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_chars long, band int")
    assert {r.doc_id: r.band for r in reading_level.bands_of_english(df, anchors).collect()} == {1: 1, 2: 5, 8: 5}
    # a document has one band, whatever else the table holds
    documents = spark.read.parquet(f"{data}/documents.parquet")
    model = reading_level.fit_anchors(anchors)
    every = {r.doc_id: r.band for r in reading_level.reading_levels(documents, model).collect()}
    asked = {r.doc_id: r.band for r in reading_level.bands_of_english(documents.where("doc_id % 3 = 0"), anchors).collect()}
    assert asked and all(every[k] == band for k, band in asked.items())
    assert reading_level.bands_of_english(df.limit(0), anchors).count() == 0
    with pytest.raises(ValueError):
        reading_level.fit_anchors(anchors.limit(0))
