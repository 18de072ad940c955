"""Same or near-same judgements across splits (problem 1).

Evaluation judgements are sharded and each shard becomes a compressed full-text index (an FM-index: the Burrows-Wheeler
transform of its folded keys as a wavelet matrix of packed bits, with a sampled suffix array). Training judgements of the
shard stream through backward search; their maximal matches are located, merged into spans for each pair of keys, and the pairs
are verified. Equal keys of one side are one key throughout: copies are only joined again at the end, and reports and
``key_overlaps`` never expand them.

A key goes to the shards of its routes. A route is what two keys of one judgement have in common wherever the slip is: the
numbers of job and résumé, or, where an id has letters that check its number, these letters and half of the number. The halves
part the keys of one job, or of ids with the same letters everywhere: no route gathers more than the keys whose numbers agree by half.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import SPLITS
from ..session import cut, parallelism
from .folding import damerau, plain

#: Keys of one shard, about; more evaluation keys make more shards.
SHARD_KEYS = 50_000
#: Of so many symbols of a text one has its place in the sampled suffix array.
SAMPLED = 8
# What copies and exports append to an id.
_MARKER = re.compile(r"(?:\.(?:txt|pdf|docx?|json|csv)|\(\d+\)|[\s_-]+v\d+|[\s_-]*copy|[\s_-]+final)\s*$")
_SEPARATORS = re.compile(r"[\W_]+")
_ZEROS = re.compile(r"(?<!\d)0+(?=\d)")
_RUN = re.compile(r"\d+|[^\W\d_]+")
_BETWEEN = 1
#: Parts a job from a résumé in a key; folded ids hold letters and digits only.
_CENTRE = "#"
#: Bound a route and a half of a number in a text.
_ROUTE, _HALF = "~", "+"
#: Marks of a whole number, and of the letters of an id without one.
_WHOLE = ("n", "w")


@functools.lru_cache(maxsize=100_000)
def fold_id(raw: str | None) -> str:
    """Folded id: case, accents, separators, leading zeros and copy markers removed; empty for null and blank ids."""
    text = plain(raw or "").strip()
    while True:
        shorter = _MARKER.sub("", text).strip()
        if shorter == text or not shorter:
            break
        text = shorter
    return _ZEROS.sub("", _SEPARATORS.sub("", text))


@functools.lru_cache(maxsize=100_000)
def numbers_and_letters(folded: str) -> tuple[str, str, bool]:
    """Digit runs, letter runs, and whether letters that check the number end the id."""
    runs = _RUN.findall(folded)
    digits = "|".join(r for r in runs if r[0].isdigit())
    letters = "|".join(r for r in runs if not r[0].isdigit())
    return digits, letters, bool(runs) and not runs[-1][0].isdigit() and len(runs[-1]) >= 3


def same_id(a: str, b: str) -> bool:
    """Whether two folded ids are one: equal, or with equal numbers and a slip of the pen in the letters, or with a slip
    in a number that equal letters behind it confirm. A number that ends an id must be equal."""
    if a == b:
        return True
    digits_a, letters_a, checked_a = numbers_and_letters(a)
    digits_b, letters_b, checked_b = numbers_and_letters(b)
    if digits_a == digits_b:
        most = 1 if min(len(letters_a), len(letters_b)) < 8 else 2
        return bool(digits_a) and damerau(letters_a, letters_b, most) <= most
    return letters_a == letters_b and checked_a and checked_b and damerau(digits_a, digits_b, 1) <= 1


def same_judgement(a: str, b: str) -> bool:
    job_a, resume_a = a.split(_CENTRE)
    job_b, resume_b = b.split(_CENTRE)
    return same_id(job_a, job_b) and same_id(resume_a, resume_b)


def _halves(digits: str, train: bool) -> list[tuple[str, str, str]]:
    """(mark, part, rest) of a number's beginnings and ends: of a training and an evaluation number that are one slip apart, one
    such part is equal. Numbers of equal length leave out a digit more, as a swap may lie across the middle; of others the mark
    tells which side is the longer, so that numbers of equal length do not meet there."""
    n = len(digits)
    cuts = [("=", n, (n - 1) // 2, (n - 1) // 2), ("<" if train else ">", n, (n + 1) // 2, n // 2), (">" if train else "<", n - 1, n // 2, (n - 1) // 2)]
    out = []
    for mark, least, head, tail in cuts:
        if least >= 0:
            out += [(f"b{mark}{least}", digits[:head], digits[head:]), (f"e{mark}{least}", digits[n - tail :], digits[: n - tail])]
    return out


def spellings(key: str, train: bool) -> list[tuple[str, str, int, int]]:
    """(route, text, start, end) of the texts of a key: in a text the route stands between what may hold the slip, from
    ``start`` to ``end``.

    Of two keys of one judgement (``same_judgement``) one route is equal: the number of an id, or its letters and half of its
    number if they check it, for the job and for the résumé. An id without a number is known by its letters alone.
    """
    sides = []
    for part in key.split(_CENTRE):
        digits, letters, checked = numbers_and_letters(part)
        own = [("n", digits, letters)] if digits else [("w", letters, "")]
        if checked:
            own += [(mark, f"{letters}{_HALF}{half}", rest) for mark, half, rest in _halves(digits, train) if rest or half]
        sides.append(own)
    out = []
    for job_mark, job, job_rest in sides[0]:
        for mark, resume, rest in sides[1]:
            route = f"{job_mark}{_ROUTE}{job}{_CENTRE}{resume}{_ROUTE}{mark}"
            # Beside half of a number only its other half is of interest: letters stand in the text of the whole numbers.
            halves = (job_mark not in _WHOLE, mark not in _WHOLE)
            before, behind = (job_rest if halves[0] or not halves[1] else ""), (rest if halves[1] or not halves[0] else "")
            out.append((route, f"{before}{route}{behind}", len(before.encode()), len((before + route).encode())))
    return out


class Bits:
    """Bit vector, packed, with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(-self.n % 64 + 64, bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order; a suffix ends with its text, of equal ones that of the earlier text is first.

    Sorted by eight bytes at first, then by twice as many until all are told apart.
    """
    n, width = len(data), 8
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    ends = np.flatnonzero(data == _BETWEEN)
    # Bytes up to the end of the text: what follows it is masked.
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
    window = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    shift = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
    window = (window >> shift) << shift
    order = np.argsort(window, kind="stable")
    new = np.concatenate([[False], (np.diff(window[order]) != 0) | (left[order][1:] <= width)])
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        pair = rank * (n + 1) + ahead
        width *= 2
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[False], np.diff(pair[order]) != 0])


class FullTextIndex:
    """FM-index of a list of byte strings. About two bytes a symbol stay after it is built: a bit for each level of the wavelet matrix with
    its ranks, and the sampled suffix array."""

    def __init__(self, texts: list[bytes]):
        between = bytes([_BETWEEN])
        data = np.frombuffer(between + between.join(texts) + between, np.uint8)
        n = self.n = len(data)
        starts = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])]) if texts else np.empty(0, np.int64)
        order = suffix_order(data)
        symbols, last = np.unique(data, return_inverse=True)
        #: Code of each byte, -1 for one that no text has.
        self.code = np.full(256, -1, np.int64)
        self.code[symbols] = np.arange(len(symbols))
        last = last[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=len(symbols)))])
        self.shifts = range(max(int(len(symbols) - 1).bit_length(), 1) - 1, -1, -1)
        self.levels: list[tuple[Bits, int]] = []
        for shift in self.shifts:
            bit = (last >> shift) & 1 > 0
            self.levels.append((Bits(bit), int(n - bit.sum())))
            last = np.concatenate([last[~bit], last[bit]])
        text = np.maximum(np.searchsorted(starts, order, "right") - 1, 0)
        marked = (order > 0) & ((order - starts[text]) % SAMPLED == 0) if texts else np.zeros(n, bool)
        self.marked, self.owner = Bits(marked), text[marked].astype(np.int32)

    def bytes_held(self) -> int:
        return sum(b.words.nbytes + b.before.nbytes for b, _ in [*self.levels, (self.marked, 0)]) + self.owner.nbytes

    def extend(self, code: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """One step of backward search for many interval bounds at once; codes are not negative."""
        low, high = np.zeros(len(bound), np.int64), bound
        for shift, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            one = (code >> shift) & 1 > 0
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return self.before[code] + high - low

    def symbol_at(self, row: np.ndarray) -> np.ndarray:
        """Code of the symbol before the suffix of each row."""
        out, at = np.zeros(len(row), np.int64), row
        for shift, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            one = bits.get(at)
            ones = bits.rank(at)
            out |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return out

    def maximal_matches(self, texts: list[bytes], stretches: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Arrays (text number, start, end, low, high) of matches that contain the text's stretch, for every end behind it, with the
        rows of the index where they occur. A match is given for each start at which it loses some of its rows, so every
        indexed text is met at its own longest match."""
        # A text whose stretch stands nowhere has no match: that is asked first, for one end of each text.
        here = self.holding(texts, stretches)
        own, texts, stretches = here, [texts[k] for k in here], [stretches[k] for k in here]
        count = [len(t) - b + 1 for t, (_, b) in zip(texts, stretches, strict=True)]
        owner = np.repeat(np.arange(len(texts)), count)
        ends = np.concatenate([np.arange(len(t), b - 1, -1) for t, (_, b) in zip(texts, stretches, strict=True)]) if texts else np.empty(0, np.int64)
        need = np.array([a for a, _ in stretches], np.int64)[owner] if len(owner) else owner
        flat = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        base = np.cumsum([0, *(len(t) for t in texts)])[:-1]
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        start = ends.copy()
        active = np.arange(len(ends))
        out = [(np.empty(0, np.int64),) * 5]
        while len(active):
            inside = start[active] > 0
            done = active[~inside & (start[active] <= need[active])]
            out.append((owner[done], start[done], ends[done], low[done], high[done]))
            active = active[inside]
            symbol = flat[base[owner[active]] + start[active] - 1]
            known = np.maximum(symbol, 0)
            lo, hi = self.extend(known, low[active]), self.extend(known, high[active])
            hi = np.where(symbol < 0, lo, hi)
            lost = active[(hi - lo < high[active] - low[active]) & (start[active] <= need[active])]
            out.append((owner[lost], start[lost], ends[lost], low[lost], high[lost]))
            going = lo < hi
            active = active[going]
            low[active], high[active] = lo[going], hi[going]
            start[active] -= 1
        number, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
        return np.array(own, np.int64)[number], *rest

    def holding(self, texts: list[bytes], stretches: list[tuple[int, int]]) -> list[int]:
        """Numbers of the texts whose stretch stands in some indexed text."""
        flat = self.code[np.frombuffer(b"".join(t[a:b] for t, (a, b) in zip(texts, stretches, strict=True)), np.uint8)]
        size = np.array([b - a for a, b in stretches], np.int64)
        at = np.cumsum(size)
        low, high = np.zeros(len(texts), np.int64), np.full(len(texts), self.n, np.int64)
        active = np.arange(len(texts))
        for step in range(int(size.max(initial=0))):
            active = active[size[active] > step]
            symbol = flat[at[active] - 1 - step]
            known = np.maximum(symbol, 0)
            lo, hi = self.extend(known, low[active]), self.extend(known, high[active])
            low[active], high[active] = lo, np.where(symbol < 0, lo, hi)
            active = active[low[active] < high[active]]
        return np.flatnonzero(low < high).tolist()

    def located(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the texts in which the rows' suffixes start: each steps back to a sampled symbol of its text."""
        out = np.full(len(rows), -1, np.int64)
        active, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(active):
            hit = self.marked.get(at)
            out[active[hit]] = self.owner[self.marked.rank(at[hit])]
            active, at = active[~hit], at[~hit]
            if len(at):
                at = self.extend(self.symbol_at(at), at)
        return out


def overlaps(index: FullTextIndex, keys: list[str], waiting: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """(training key, evaluation key, covered symbols, spans) of (key, text, start, end) streamed through an index of the
    texts of ``keys``. Matches of a pair are merged into spans; pairs are verified."""
    raw = [t.encode() for _, t, _, _ in waiting]
    text, start, end, low, high = index.maximal_matches(raw, [(a, b) for _, _, a, b in waiting])
    size = high - low
    rows = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    found = np.column_stack([np.repeat(text, size), index.located(rows), np.repeat(start, size), np.repeat(end, size)])
    out = []
    now, good = None, False
    covered = reach = merged = 0
    for t, e, a, b in np.unique(found, axis=0).tolist():
        if (t, e) != now:
            if good:
                out.append((waiting[now[0]][0], keys[now[1]], covered, merged))
            now, good = (t, e), same_judgement(waiting[t][0], keys[e])
            covered = reach = merged = 0
        merged += a >= reach
        covered += max(0, b - max(a, reach))
        reach = max(reach, b)
    if good:
        out.append((waiting[now[0]][0], keys[now[1]], covered, merged))
    return out


def judged(labels: DataFrame) -> DataFrame:
    """``label_id``, ``role`` (train or eval), ``split``, ``source`` and ``key`` of each label of a known split.

    Null, blank and unknown splits take no part, nor do labels without an id, a job or a résumé.
    """
    known = F.create_map(*(F.lit(x) for kv in SPLITS.items() for x in kv))
    split = known[F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))]
    rows = labels.select(F.col("label_id").cast("long").alias("label_id"), split.alias("split"), F.trim(F.lower("source")).alias("source"), "job_id", "resume_id").where("split is not null and label_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for job, resume in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                job, resume = fold_id(job), fold_id(resume)
                keys.append(f"{job}{_CENTRE}{resume}" if job and resume else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.string())], names=["label_id", "split", "source", "key"])

    out = rows.mapInArrow(run, "label_id bigint, split string, source string, key string").where("key is not null")
    return out.withColumn("role", F.when(F.col("split") == "train", "train").otherwise("eval"))


def key_pairs(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``train_key``, ``eval_key``, ``covered`` and ``matches`` of the pairs of one judgement, from distinct (role, key)."""
    spark = keys.sparkSession
    shards = max(parallelism(spark), 4 * keys.where("role = 'eval'").count() // shard_keys + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (zlib.crc32(way.encode()) % shards, role == "train", key, text, start, end)
                for role, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for way, text, start, end in spellings(key, role == "train")
            ]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "train", "key", "text", "start", "end"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: int | None = None
        keys: list[str] = []
        texts: list[bytes] = []
        index: FullTextIndex | None = None
        for batch in batches:
            found: list[tuple] = []
            waiting: list[tuple[str, str, int, int]] = []
            for s, train, key, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    found += overlaps(index, keys, waiting) if index and waiting else []
                    shard, keys, texts, index, waiting = s, [], [], None, []
                if not train:
                    keys.append(key)
                    texts.append(text.encode())
                elif keys:
                    index = index or FullTextIndex(texts)
                    waiting.append((key, text, start, end))
            found += overlaps(index, keys, waiting) if index and waiting else []
            columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["train_key", "eval_key", "covered", "matches"])

    routed = keys.select("role", "key").mapInArrow(route, "shard int, train boolean, key string, text string, start int, end int")
    # Evaluation keys of a shard come first, so the index stands before the shard's training keys stream by.
    sharded = routed.repartition(shards, "shard").sortWithinPartitions("shard", "train", "key")
    pairs = sharded.mapInArrow(search, "train_key string, eval_key string, covered int, matches int")
    return pairs.groupBy("train_key", "eval_key").agg(F.max("covered").alias("covered"), F.max("matches").alias("matches"))


def key_overlaps(labels: DataFrame) -> DataFrame:
    """``train_key``, ``eval_key``, ``train_labels``, ``eval_labels``, ``covered``: each pair of keys of one judgement with the labels
    that hold them. The form that scales: copies are counted, not paired."""
    rows = cut(judged(labels))
    counts = rows.groupBy("role", "key").agg(F.count("*").alias("n"))
    train = counts.where("role = 'train'").select(F.col("key").alias("train_key"), F.col("n").alias("train_labels"))
    held = counts.where("role = 'eval'").select(F.col("key").alias("eval_key"), F.col("n").alias("eval_labels"))
    return key_pairs(rows.select("role", "key").distinct()).join(train, "train_key").join(held, "eval_key").select("train_key", "eval_key", "train_labels", "eval_labels", "covered")


def overlapping_labels(labels: DataFrame) -> DataFrame:
    """``p1_found``: pairs of label ids, the smaller first."""
    rows = cut(judged(labels))
    pairs = key_pairs(rows.select("role", "key").distinct())
    train = rows.where("role = 'train'").select(F.col("key").alias("train_key"), F.col("label_id").alias("t"))
    held = rows.where("role = 'eval'").select(F.col("key").alias("eval_key"), F.col("label_id").alias("e"))
    both = pairs.join(train, "train_key").join(held, "eval_key")
    return both.select(F.least("t", "e").alias("left_label_id"), F.greatest("t", "e").alias("right_label_id")).distinct()


def overlap_report(labels: DataFrame) -> DataFrame:
    """Labels of each evaluation split and source, how many repeat a training judgement, and how many of these only
    almost. Counted on keys: no pair of copies is made."""
    rows = cut(judged(labels))
    pairs = key_pairs(rows.select("role", "key").distinct())
    met = pairs.groupBy(F.col("eval_key").alias("key")).agg(F.max((F.col("train_key") == F.col("eval_key")).cast("int")).alias("exact"))
    held = rows.where("role = 'eval'").join(met, "key", "left")
    return held.groupBy("split", "source").agg(
        F.count("*").alias("labels"), F.count("exact").alias("overlapping"), F.coalesce(F.sum((F.col("exact") == 0).cast("long")), F.lit(0)).alias("spelled_otherwise")
    )
