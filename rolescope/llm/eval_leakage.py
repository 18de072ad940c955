"""Evaluation texts leaking into the corpus (problem 9).

Held-out items are few and the corpus is large, so the items become an index that every task holds, and each document
is read once, without a shuffle:

1. words are folded (layout, case, punctuation, look-alike letters, hyphens at line ends);
2. windows of a minimum passage's length slide over every document; a window is kept for an item if it holds enough of that
   item's word pairs. An edit destroys two pairs at most, so no passage within the edit budget is dropped here;
3. a CGK random walk turns each kept window into a string on which few edits are few Hamming differences, and repeated
   samples of its positions are looked up in the tables of the items' windows;
4. window pairs that met are verified by banded edit distance, and the passage around them by exact alignment.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .batches import text_slices
from .folding import INVISIBLE, LOOKALIKE

#: Words of the shortest passage that counts.
PASSAGE_WORDS = 20
#: Altered words that such a passage may hold: every third word. A word that is torn or run together counts twice.
MAX_EDITS = 6
#: CGK walks, samples of each walk, and positions of each sample: see README for the recall they reach.
WALKS, SAMPLES, POSITIONS = 24, 8, 4
#: Walks after which what was met is verified; what a document is known to hold needs no further walks.
ROUND_WALKS = 3
#: Characters of items that one index may hold; more items are handled in further passes over the corpus.
BLOCK_CHARS = 8_000_000
#: Kept windows looked up at once in a task.
CHUNK = 200_000

#: Dashes and slashes part words, hyphens join them.
_DASHES = re.compile("[—–―‒⸺/]|--+")
_BROKEN = re.compile("-[ \\t]*[\\r\\n  \u0085]+[ \\t>|*#]*(?=\\w)")
_MARKS = re.compile(r"[^\w\s]|_")
_ASCII_MARKS = bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())
_ASCII_SMALL = bytes(range(256)).lower()
_LOOKS = re.compile("[" + "".join(map(chr, LOOKALIKE)) + "]")
#: Steps (item words, document words) between two equal words with one altered word between them, the word being
#: changed, left out, added, or torn in two.
_GAPS = ((2, 2), (2, 1), (1, 2), (2, 3))


def words(text: str | None) -> list[str]:
    """Folded words of a text; none for null, empty and blank texts."""
    if not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text).lower())
        if _LOOKS.search(text):
            text = text.translate(LOOKALIKE)
        if "-" in text:
            text = _BROKEN.sub("", text)
        return _MARKS.sub("", _DASHES.sub(" ", text)).split()
    if "-" in text:
        text = _BROKEN.sub("", text)
    if "/" in text or "--" in text:
        text = _DASHES.sub(" ", text)
    return text.encode("ascii").translate(_ASCII_SMALL, _ASCII_MARKS).decode("ascii").split()


def placed(own: list) -> dict:
    """Places of each word."""
    out: dict = {}
    for k, x in enumerate(own):
        out.setdefault(x, []).append(k)
    return out


@dataclass(frozen=True)
class ItemIndex:
    ids: list[int]
    vocabulary: dict[str, int]
    codes: list[np.ndarray]
    places: list[dict[int, list[int]]]
    #: Neighbouring words run together, and where they stand in each item.
    joined: dict[str, int]
    joins: list[dict[int, list[int]]]
    #: Distinct word pairs, where the items of each begin in ``pair_items``.
    pairs: np.ndarray
    pair_first: np.ndarray
    pair_items: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    bits: np.ndarray
    samples: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]


def _hash(parts: np.ndarray) -> np.ndarray:
    """64-bit mix of the columns of an integer matrix."""
    h = np.full(len(parts), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(parts.shape[1]):
        h ^= parts[:, k].astype(np.uint64) + np.uint64(k + 1)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def walk(windows: np.ndarray, bits: np.ndarray, steps: int) -> np.ndarray:
    """CGK embedding of integer windows: at each step write the current symbol, then advance by a random bit that
    depends on step and symbol; past the end write the last symbol number. ``bits`` has a row for every 64 steps and a number
    for each symbol, whose bits are those of the steps."""
    n, width = windows.shape
    padded = np.column_stack([windows, np.full(n, bits.shape[1] - 1, windows.dtype)])
    at = np.zeros(n, np.int64)
    rows = np.arange(n) * (width + 1)
    flat = padded.ravel()
    out = np.empty((steps, n), np.int32)
    for step in range(steps):
        symbol = flat[rows + at]
        out[step] = symbol
        at = np.minimum(at + ((bits[step // 64, symbol] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64), width)
    return out


@functools.lru_cache(maxsize=4)
def build_index(items: tuple[tuple[int, str], ...], passage: int = PASSAGE_WORDS) -> ItemIndex:
    """Index of (item_id, text) pairs; cached by content, so each worker builds it once."""
    ids = [i for i, _ in items]
    split = [words(t) for _, t in items]
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in split for w in ws}))}
    unknown = len(vocabulary)
    codes = [np.array([vocabulary[w] for w in ws], np.int32) for ws in split]
    places = [placed(c.tolist()) for c in codes]
    joined: dict[str, int] = {}
    joins = []
    for ws in split:
        own = [a + b for a, b in zip(ws, ws[1:], strict=False)]
        joins.append(placed([joined.setdefault(w, unknown + 1 + len(joined)) for w in own]))
    two = [np.unique(c[:-1].astype(np.int64) * (unknown + 1) + c[1:]) for c in codes]
    every = np.concatenate(two) if two else np.empty(0, np.int64)
    order = np.argsort(every, kind="stable")
    pairs, pair_first = np.unique(every[order], return_index=True)
    pair_items = np.repeat(np.arange(len(two)), [len(t) for t in two])[order]
    views = [(np.lib.stride_tricks.sliding_window_view(c, passage), k) for k, c in enumerate(codes) if len(c) >= passage]
    windows = np.concatenate([v for v, _ in views]) if views else np.empty((0, passage), np.int32)
    owner = np.concatenate([np.full(len(v), k, np.int32) for v, k in views]) if views else np.empty(0, np.int32)
    rng = np.random.default_rng(20_240_901)
    steps = 3 * passage
    bits = rng.integers(0, 1 << 63, (WALKS, (steps + 63) // 64, unknown + 2), dtype=np.uint64) ^ (rng.integers(0, 2, (WALKS, 1, unknown + 2), dtype=np.uint64) << np.uint64(63))
    # A walk advances half a word a step: positions past twice the window hold little but its end.
    samples = np.stack([np.stack([np.sort(rng.choice(2 * passage, POSITIONS, replace=False)) for _ in range(SAMPLES)]) for _ in range(WALKS)])
    tables = []
    for r in range(WALKS):
        out = walk(windows, bits[r], 2 * passage)
        for sample in samples[r]:
            keys = _hash(out[sample].T)
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], order))
    return ItemIndex(ids, vocabulary, codes, places, joined, joins, pairs, np.append(pair_first, len(pair_items)), pair_items, windows, owner, bits, samples, tables)


@dataclass(frozen=True)
class Kept:
    """Windows that hold enough word pairs of one item: for each item, ranges of starts, as sorted keys."""

    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: int

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Item and start of each kept window, for every item that it is kept for."""
        if not len(self.low):
            return self.low, self.low
        begins = np.concatenate([[True], self.low[1:] > self.high[:-1]])
        low = self.low[begins]
        size = np.append(self.high[:-1][begins[1:]], self.high[-1]) - low + 1
        key = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return key // self.size, key % self.size

    def holds(self, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        key = item.astype(np.int64) * self.size + start
        at = np.searchsorted(self.low, key, "right") - 1
        return (at >= 0) & (self.high[np.maximum(at, 0)] >= key)


def kept_windows(index: ItemIndex, codes: np.ndarray, passage: int, max_edits: int) -> Kept:
    """Windows of which enough word pairs occur in one item. ``codes`` has -1 between documents and for words that no item
    has; at its end stands a window's length of -1."""
    size, need = len(codes) + 1, max(passage - 1 - 2 * max_edits, 1)
    nothing = np.empty(0, np.int64)
    unknown = len(index.vocabulary)
    good = (codes >= 0) & (codes < unknown)
    known = np.flatnonzero(good[:-1] & good[1:]) if len(codes) >= passage and len(index.pairs) else nothing
    if not len(known):
        return Kept(nothing, nothing, nothing, size)
    value = codes[known].astype(np.int64) * (unknown + 1) + codes[known + 1]
    at = np.minimum(np.searchsorted(index.pairs, value), len(index.pairs) - 1)
    hit = index.pairs[at] == value
    known, at = known[hit], at[hit]
    n = index.pair_first[at + 1] - index.pair_first[at]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = index.pair_items[np.repeat(index.pair_first[at], n) + step] * np.int64(size) + np.repeat(known, n)
    key.sort()
    # Runs of ``need`` pairs of one item that fit into a window; the window begins between these bounds.
    run = np.flatnonzero(key[need - 1 :] - key[: len(key) - need + 1] <= passage - 2)
    first, last = key[run], key[run + need - 1]
    same = first // size == last // size
    first, last = first[same], last[same]
    low = np.maximum(last - (passage - 2), first // size * size)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(first[order]) if len(first) else first
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, low % size, 1)
    np.add.at(edge, first[order] % size + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(codes) - passage + 1] > 0)
    return Kept(starts, low, high, size)


def near_windows(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Least edits that turn each window of ``a`` into a prefix of ``b``'s row (``band`` words longer), computed over a
    band of ``band`` diagonals to either side, for all rows at once."""
    n, m = a.shape
    width = 2 * band + 1
    far = np.int16(m + 1)
    row = np.full((width, n), far, np.int16)
    for k in range(band, width):
        row[k] = k - band
    for i in range(1, m + 1):
        new = np.full((width, n), far, np.int16)
        for k in range(width):
            j = i + k - band
            if j < 0 or j > b.shape[1]:
                continue
            if j == 0:
                new[k] = i
                continue
            best = row[k] + (a[:, i - 1] != b[:, j - 1])
            if k + 1 < width:
                best = np.minimum(best, row[k + 1] + 1)
            if k:
                best = np.minimum(best, new[k - 1] + 1)
            new[k] = best
        row = new
    return row.min(axis=0)


def longest_passage(places: dict, doc: list, joins: dict | None = None) -> int:
    """Item words of the longest passage that ``doc`` repeats with single altered words only.

    A passage begins and ends with equal words; between two runs of equal words stands one altered word, or one that runs two
    words of the item together (``joins``: where the item has each such word), and a run that is followed by one has two
    words or more.
    """
    longest = 0
    before: list[dict[int, tuple[int, int]]] = [{}, {}, {}]
    word_before = None
    for x in doc:
        now: dict[int, tuple[int, int]] = {}
        together = joins.get(word_before) if joins else None
        for i in places.get(x, ()):
            last = before[-1].get(i - 1)
            if last:
                start, run = last[0], last[1] + 1
            else:
                start, run = i, 1
                for item_step, doc_step in _GAPS:
                    last = before[-doc_step].get(i - item_step)
                    if last and last[1] >= 2 and last[0] < start:
                        start = last[0]
                if together and i - 2 in together:
                    last = before[-2].get(i - 3)
                    if last and last[1] >= 2 and last[0] < start:
                        start = last[0]
            now[i] = (start, run)
            longest = max(longest, i - start + 1)
        before = [before[1], before[2], now]
        word_before = x
    return longest


def met_windows(index: ItemIndex, kept: Kept, starts: np.ndarray, filled: np.ndarray, passage: int, walks: range) -> tuple[np.ndarray, np.ndarray]:
    """Of windows at ``starts``: starts and the item windows they met in some table of ``walks``, each pair once; only pairs with
    an item of which the window holds enough word pairs."""
    total = max(len(index.windows), 1)
    starts_of, theirs_of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, len(starts), CHUNK):
        part = starts[begin : begin + CHUNK]
        windows = filled[part[:, None] + np.arange(passage)]
        met = [np.empty(0, np.int64)]
        for r in walks:
            out = walk(windows, index.bits[r], 2 * passage)
            for s, sample in enumerate(index.samples[r]):
                keys, order = index.tables[r * len(index.samples[r]) + s]
                mine = _hash(out[sample].T)
                lo = np.searchsorted(keys, mine)
                own = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == mine) if len(keys) else np.empty(0, np.int64)
                if len(own):
                    lo, hi = lo[own], np.searchsorted(keys, mine[own], "right")
                    size = hi - lo
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    window, theirs = np.repeat(own, size), order[np.repeat(lo, size) + step]
                    good = kept.holds(index.owner[theirs], part[window])
                    met.append(window[good] * total + theirs[good])
        every = np.unique(np.concatenate(met))
        starts_of.append(part[every // total])
        theirs_of.append(every % total)
    return np.concatenate(starts_of), np.concatenate(theirs_of)


def verified_groups(index: ItemIndex, filled: np.ndarray, where: np.ndarray, theirs: np.ndarray, group: np.ndarray, passage: int, max_edits: int) -> np.ndarray:
    """Groups of which some window pair is within the edits. A few pairs of each are tried, then more of those without one."""
    order = np.argsort(group, kind="stable")
    where, theirs, group = where[order], theirs[order], group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    bound = np.append(first, len(group))
    verified = np.zeros(len(first), bool)
    done, tries = np.zeros(len(first), np.int64), 1
    while True:
        left = np.flatnonzero(~verified & (first + done < bound[1:]))
        if not len(left):
            return group[first[verified]]
        n = np.minimum(tries, bound[left + 1] - first[left] - done[left])
        of = np.repeat(left, n)
        pick = np.repeat(first[left] + done[left], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for low in range(0, len(pick), CHUNK):
            own = pick[low : low + CHUNK]
            b = filled[where[own][:, None] + np.arange(passage + max_edits)]
            verified[of[low : low + CHUNK][near_windows(index.windows[theirs[own]], b, max_edits) <= max_edits]] = True
        done[left] += n
        tries *= 4


def leaks_of(index: ItemIndex, doc_words: list[list[str]], passage: int = PASSAGE_WORDS, max_edits: int = MAX_EDITS) -> list[tuple[int, int, int]]:
    """(document number, item id, longest repeated passage in words) of some documents given as words."""
    unknown = len(index.vocabulary)
    lookup = (index.joined | index.vocabulary).get
    starts = np.cumsum([0, *(len(ws) + 1 for ws in doc_words)])
    codes = np.full(int(starts[-1]) + passage, -1, np.int32)
    for at, ws in zip(starts.tolist(), doc_words, strict=False):
        codes[at : at + len(ws)] = [lookup(w, -1) for w in ws]
    kept = kept_windows(index, codes, passage, max_edits)
    filled = np.full(len(codes) + max_edits, unknown, np.int32)
    filled[: len(codes)] = np.where((codes < 0) | (codes > unknown), unknown, codes)
    # Each kept window for an item belongs to a document and item; these are asked about until one window pair is verified.
    item, start = kept.pairs()
    key = (np.searchsorted(starts, start, "right") - 1) * np.int64(len(index.ids)) + item
    groups, group = np.unique(key, return_inverse=True)
    found = np.zeros(len(groups), bool)
    for first in range(0, len(index.bits), ROUND_WALKS):
        going = np.unique(start[~found[group]])
        if not len(going):
            break
        where, theirs = met_windows(index, kept, going, filled, passage, range(first, min(first + ROUND_WALKS, len(index.bits))))
        met = np.searchsorted(groups, (np.searchsorted(starts, where, "right") - 1) * np.int64(len(index.ids)) + index.owner[theirs])
        fresh = ~found[met]
        if fresh.any():
            found[verified_groups(index, filled, where[fresh], theirs[fresh], met[fresh], passage, max_edits)] = True
    low_of, high_of = np.full(len(groups), len(codes)), np.zeros(len(groups), np.int64)
    np.minimum.at(low_of, group, start)
    np.maximum.at(high_of, group, start)
    out = []
    for g in np.flatnonzero(found).tolist():
        d, i = divmod(int(groups[g]), len(index.ids))
        margin = 2 * len(index.codes[i]) + passage
        low, high = max(int(low_of[g]) - margin, int(starts[d])), min(int(high_of[g]) + margin, int(starts[d]) + len(doc_words[d]))
        span = longest_passage(index.places[i], codes[low:high].tolist(), index.joins[i])
        if span >= passage:
            out.append((d, index.ids[i], span))
    return out


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items as blocks of bounded size, collected one after the other. Null texts have no passages; repeated ids keep all
    their texts."""
    rows = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    for k in range(n):
        yield tuple(sorted((r.item_id, r.text) for r in (rows.where(part == k) if n > 1 else rows).collect()))


def leaked_items(documents: DataFrame, items: DataFrame, passage: int = PASSAGE_WORDS, max_edits: int = MAX_EDITS,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id`` and ``words``, the item words of the longest repeated passage, for each document and item
    with a passage of ``passage`` words or more.

    Null, empty and short texts repeat nothing. Equal documents each come out. An empty table of items gives no rows.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def scan(block: tuple[tuple[int, str], ...]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = build_index(block, passage)
            for ids, texts in text_slices(batches):
                found = leaks_of(index, [words(t) for t in texts], passage, max_edits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int32())],
                    names=["doc_id", "item_id", "words"],
                )

        return source.mapInArrow(run, "doc_id bigint, item_id bigint, words int")

    blocks = item_blocks(items, block_chars)
    out = scan(next(blocks))
    for number, block in enumerate(blocks):
        # With several blocks each result is written before the next block is collected: the driver holds one at a time.
        out = (out if number else cut(out)).unionByName(cut(scan(block)))
    return out


def leaked_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Leaking documents and longest passage of each item, items without a leak included."""
    found = leaked_items(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))
    return items.select("item_id", "benchmark").join(found, "item_id", "left").select(
        "item_id", "benchmark", F.coalesce("documents", F.lit(0)).alias("documents"), "longest"
    )
