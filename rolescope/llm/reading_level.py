"""Reading level of each document (problem 10).

A linear ranker learned from pairs of graded passages scores syntax and vocabulary features; isotonic regression over
the graded passages turns scores into bands. The features of the corpus are counted with array operations over the raw
UTF-8 buffers of Arrow batches: no word ever becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Graded passages beyond this number are left out of the fit, lowest anchor_id first kept.
MAX_ANCHORS = 2_000
# Class of each byte.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?;"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32, 0xC2, 0xE2]] = True  # the last two begin the non-ASCII blanks and quotes
# Words that open a subordinate clause, words without a meaning of their own, and ends of derived words.
_CLAUSE = "because until before after although unless while whether since which that who whom whose when where if though whereas once".split()
_FUNCTION = (
    "the a an of to in on at by for from with and or but as is are was were be been must may should can will would could might "
    "they he she it we you this these those their his her its our your not no each every all both some any one two"
).split()
_DERIVED = "tion sion ment ness ance ence ical logy ious able ible ally ship hood edly isms ists ized ised".split()
_DERIVED_SHORT = "ity ive ism ize ise ful".split()
FEATURES = (
    "log_words_per_sentence", "letters_per_word", "vowel_runs_per_word", "share_7", "share_10", "share_13", "log_commas_per_sentence",
    "clauses_per_sentence", "share_function_words", "share_3_vowel_runs", "share_4_vowel_runs", "share_to_4", "share_derived",
)
#: Letters of a word that its code holds: longer words are none of the listed ones.
_CODED = 8


def _codes(words: list[str]) -> np.ndarray:
    return np.unique(np.array([int.from_bytes(w.encode(), "big") for w in words], np.uint64))


_CLAUSE_CODES, _FUNCTION_CODES, _DERIVED_CODES, _DERIVED_SHORT_CODES = map(_codes, (_CLAUSE, _FUNCTION, _DERIVED, _DERIVED_SHORT))


def _among(codes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, codes), len(listed) - 1)] == codes


def _windows(small: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` (8 or 4) bytes that begin at each place, as numbers; zeros follow the end. A view, no copy."""
    padded = np.concatenate([small, np.zeros(8, np.uint8)])
    return np.ndarray((len(small),), f">u{width}", padded, strides=(1,))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of texts that lie in one UTF-8 buffer; a row of zeros for a text without a word.

    Syntax: words, commas and subordinate clauses a sentence, share of function words. Vocabulary: length, runs of vowels and
    derived forms of words. Sentences end at a full stop, question or exclamation mark or semicolon before a blank or the end; a text without
    any counts as one sentence. Continuation bytes of letters beyond ASCII are not counted as letters.
    """
    n = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets.astype(np.int64) - lo
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    bounds = offsets[:-1][np.diff(offsets) > 0]
    first = np.zeros(len(data), bool)
    first[bounds] = True
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True

    letter = _LETTER[data]
    before = np.empty_like(letter)
    before[0], before[1:] = False, letter[:-1]
    before[first] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.empty_like(letter)
    after[-1], after[:-1] = False, letter[1:]
    after[last] = False
    ends = np.flatnonzero(letter & ~after) + 1
    single = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
    single = np.concatenate([[0], single])
    sizes = single[ends] - single[starts]

    vowel = _VOWEL[data]
    run = vowel.copy()
    run[1:] &= ~vowel[:-1] | first[1:]
    end = _END[data]
    follow = np.empty_like(end)
    follow[-1], follow[:-1] = True, _BLANK[data[1:]]
    end &= follow | last

    def per_text(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.diff(np.searchsorted(at, offsets))

    at = np.searchsorted(starts, offsets)
    words = np.diff(at).astype(float)
    total = np.concatenate([[0], np.cumsum(sizes)])
    letters = np.diff(total[at])
    counted = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    share = [counted(sizes >= k) for k in (7, 10, 13)]
    sentences = np.maximum(per_text(end), 1)
    some = np.maximum(words, 1)
    runs = np.concatenate([[0], np.cumsum(run)])
    runs = runs[ends] - runs[starts]
    small = data | 0x20
    length = ends - starts
    listed = np.minimum(length, _CODED).astype(np.uint64)
    coded = np.where(length <= _CODED, _windows(small, 8)[starts].astype(np.uint64) >> ((_CODED - listed) * np.uint64(8)), 0)
    long = np.flatnonzero(length >= 7)
    last = _windows(small, 4)[ends[long] - 4].astype(np.uint64)
    derived = np.zeros(len(starts), bool)
    derived[long] = _among(last, _DERIVED_CODES) | _among(last & np.uint64(0xFFFFFF), _DERIVED_SHORT_CODES)
    out = np.column_stack([
        np.log(some / sentences), letters / some, per_text(run) / some, *(s / some for s in share), np.log1p(per_text(data == 44) / sentences),
        counted(_among(coded, _CLAUSE_CODES)) / sentences, counted(_among(coded, _FUNCTION_CODES)) / some,
        counted(runs >= 3) / some, counted(runs >= 4) / some, counted(sizes <= 4) / some, counted(derived) / some,
    ])
    out[words == 0] = 0
    return out


def text_features(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of ``y`` on ``x`` (pool adjacent violators)."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, right = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = right
    knots = [(at, s / w) for s, w, left, right in blocks for at in dict.fromkeys((left, right))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass(frozen=True)
class LevelModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def level(self, x: np.ndarray) -> np.ndarray:
        """Calibrated level on the anchors' scale, between the anchors by straight lines."""
        return np.interp(self.score(x), self.knots, self.levels)

    def band(self, x: np.ndarray) -> np.ndarray:
        return np.floor(self.level(x) + 0.5).astype(np.int32)


def fit(x: np.ndarray, bands: np.ndarray, rounds: int = 400, ridge: float = 1e-2) -> LevelModel:
    """Pairwise logistic ranker (each pair of passages of different bands) and its isotonic calibration.

    Needs passages of at least one band; with a single band every text gets that band.
    """
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    hi, lo = np.nonzero(bands[:, None] > bands[None, :])
    w = np.zeros(x.shape[1])
    if len(hi):
        d = z[hi] - z[lo]
        gap = (bands[hi] - bands[lo]).astype(float)
        step = 4.0 / max(np.linalg.norm(d, 2) ** 2 / len(d), 1e-9)
        for _ in range(rounds):
            slope = -1.0 / (1.0 + np.exp(np.clip(d @ w / gap, -30, 30))) / gap
            w -= step * (d.T @ slope / len(d) + ridge * w)
    knots, levels = isotonic(z @ w, bands.astype(float))
    return LevelModel(mean, scale, w, knots, levels)


def fit_anchors(anchors: DataFrame, max_anchors: int = MAX_ANCHORS) -> LevelModel:
    """Model of a table of graded passages (anchor_id, band, text); rows with a null band or text are no passages."""
    rows = anchors.where("band is not null and text is not null").orderBy("anchor_id").limit(max_anchors).select("band", "text").collect()
    if not rows:
        raise ValueError("no graded passages to learn from")
    return fit(text_features([r.text for r in rows]), np.array([r.band for r in rows]))


def _scores(documents: DataFrame, model: LevelModel) -> DataFrame:
    """``doc_id`` and ``score`` of each document, null for a null text and a text without a single word."""
    source = documents.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64(), mask=~x.any(axis=1))], names=["doc_id", "score"])

    return source.mapInArrow(run, "doc_id bigint, score double")


def reading_levels(documents: DataFrame, model: LevelModel) -> DataFrame:
    """``doc_id``, ``level`` (DOUBLE) and ``band`` of each document.

    A null text, and a text without a single word, has null level and band. Whole texts are read; the only data that
    leaves the scan is the text itself, in one pass without a shuffle. Levels between the knots are straight lines, inside
    the JVM.
    """
    score = F.col("score")
    level = F.when(score <= float(model.knots[0]), float(model.levels[0]))
    for x0, x1, y0, y1 in zip(model.knots, model.knots[1:], model.levels, model.levels[1:], strict=False):
        if x1 > x0:
            level = level.when(score <= float(x1), float(y0) + (score - float(x0)) * float((y1 - y0) / (x1 - x0)))
    level = F.when(score.isNotNull(), level.otherwise(float(model.levels[-1])))
    return _scores(documents, model).select("doc_id", level.alias("level")).withColumn("band", F.floor(F.col("level") + 0.5).cast("int"))


def bands_of_english(documents: DataFrame, anchors: DataFrame, lang: str = "en", least_chars: int = 600) -> DataFrame:
    """``p10_found``: the band of each document of the language with at least so many characters.

    Documents whose language or length is null are not asked for.
    """
    asked = documents.where((F.col("lang") == lang) & (F.col("n_chars") >= least_chars))
    return reading_levels(asked, fit_anchors(anchors)).select("doc_id", "band").where("band is not null")


def band_profile(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """Documents and mean level of each source and band, over all documents; null band where a text has no word."""
    levels = reading_levels(documents, fit_anchors(anchors))
    # The source travels by a join on the key: only the text goes through Python.
    return documents.select("doc_id", "source").join(levels, "doc_id").groupBy("source", "band").agg(
        F.count("*").alias("documents"), F.round(F.avg("level"), 6).alias("mean_level")
    )
