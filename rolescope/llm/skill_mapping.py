"""Mapping of freely typed values to a canonical list (problem 2).

An Aho-Corasick automaton over folded names and aliases finds mentions anywhere in a value; mentions that overlap a longer one
are dropped, and the value means the longest of those that are left. Values without a mention go to token-set similarity: every
word of an entry must have its word in the value, as typed, abbreviated or with few typing errors, in any order. What is
left is compared letter by letter, blanks ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Container, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .folding import damerau, plain

#: Entries that one automaton may hold; of a larger list one block at a time is collected and passed over. What a block knows of
#: a value goes to the same rules as what a whole list knows, so the size of blocks changes no result.
BLOCK_ENTRIES = 50_000
#: Least share of an entry's letters that must agree.
LEAST_SIMILARITY = 0.7
#: Distinct values remembered by a worker.
CACHE_VALUES = 200_000

_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")
_MARKS = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+\.?")

Clues = tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]
Guesses = tuple[list[tuple[float, int]], Iterable[tuple[int, int, str, int, int]]]


def forms(value: str) -> list[str]:
    """Folded spellings of a value, words parted by single blanks: as typed, and with inner capitals parted."""
    typed = _MARKS.sub(" ", plain(value)).strip()
    parted = _MARKS.sub(" ", plain(_CAMEL.sub(" ", value))).strip()
    return [typed] if parted == typed else [typed, parted]


def _deletes(word: str, most: int) -> set[str]:
    out = level = {word}
    for _ in range(most):
        level = {w[:k] + w[k + 1 :] for w in level for k in range(len(w))}
        out = out | level
    return out


def _tokens(value: str) -> list[list[str]]:
    """Words of a value with the dots behind them: as typed, and with inner capitals parted."""
    return [_WORD.findall(text) for text in (plain(value), plain(_CAMEL.sub(" ", value)))]


class Catalog:
    """What (id, name, aliases) entries, ordered by id, tell of a value; a null or blank name or alias is left out.

    The entries may be a block of a longer list that holds whole ids: ``clues`` and ``guesses`` leave every choice that
    other entries could change to ``settled`` and ``guessed``.
    """

    def __init__(self, entries: tuple[tuple[int, str, tuple[str, ...]], ...]):
        self.entries: list[tuple[int, list[str]]] = []
        self.by_word: dict[str, list[int]] = {}
        #: Letters without blanks, (0, id) of a name in either order, (1, id) of a spelling.
        self.compact: dict[str, tuple[int, int]] = {}
        self.spellings: dict[str, int] = {}
        for key, name, aliases in entries:
            for text in (name, *aliases):
                for form in forms(text or ""):
                    if form:
                        self.spellings.setdefault(form, key)
            words = forms(name or "")[0].split()
            if not words:
                continue
            for order in (words, words[::-1]):
                self.compact.setdefault("".join(order), (0, key))
            for w in set(words):
                self.by_word.setdefault(w, []).append(len(self.entries))
            self.entries.append((key, words))
        for form, key in self.spellings.items():
            self.compact.setdefault(form.replace(" ", ""), (1, key))

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for form, key in self.spellings.items():
            out.add_word(f" {form} ", (len(form), key))
        out.make_automaton()
        return out

    @functools.cached_property
    def near(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for w in self.by_word:
            for d in _deletes(w, self.edits(w)):
                out.setdefault(d, set()).add(w)
        return out

    @functools.cached_property
    def prefixes(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for w in self.by_word:
            for k in range(3, len(w)):
                out.setdefault(w[:k], set()).add(w)
        return out

    @functools.cached_property
    def joined(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for c in self.compact:
            for d in _deletes(c, self.slips(c)):
                out.setdefault(d, set()).add(c)
        return out

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) < 4 else 1 if len(word) < 5 else 2

    @staticmethod
    def slips(letters: str) -> int:
        return 0 if len(letters) < 6 else 1 if len(letters) < 10 else 2

    def clues(self, value: str) -> Clues:
        """All mentions (form, start, length, id), overlapping ones too, and entries of the same letters (form, rank, id)."""
        own = forms(value)
        found = ((f, self.automaton.iter(f" {form} ")) for f, form in enumerate(own) if len(self.automaton))
        hits = [(f, end - length, length, key) for f, ends in found for end, (length, key) in ends]
        same = [(f, *self.compact[c]) for f, c in enumerate(form.replace(" ", "") for form in own) if c in self.compact]
        return hits, same

    def words(self, value: str) -> list[str]:
        """Words of a value that names hold."""
        return sorted({token.rstrip(".") for tokens in _tokens(value) for token in tokens} & self.by_word.keys())

    def like(self, token: str, known: Container[str]) -> dict[str, float]:
        """Words of the catalog that a typed word may stand for, and how alike they are; a ``known`` word stands for itself."""
        bare = token.rstrip(".")
        if bare in known:
            return {bare: 1.0} if bare in self.by_word else {}
        found: dict[str, float] = {}
        for w in self.prefixes.get(bare, ()) if len(bare) >= 3 else ():
            found[w] = 0.9 if token.endswith(".") else 0.8
        if len(bare) >= 4:
            for d in _deletes(bare, 2 if len(bare) >= 5 else 1):
                for w in self.near.get(d, ()):
                    if w not in found:
                        n = damerau(bare, w, self.edits(w))
                        if n <= self.edits(w):
                            found[w] = 1 - n / len(w)
        return found

    def similar(self, value: str, known: Container[str]) -> list[tuple[float, int]]:
        """(similarity, id) of the two entries most like the value by their sets of words, those alike enough only."""
        best: dict[int, float] = {}
        for tokens in _tokens(value):
            scores: dict[int, dict[str, float]] = {}
            for token in tokens:
                for w, s in self.like(token, known).items():
                    for e in self.by_word[w]:
                        own = scores.setdefault(e, {})
                        own[w] = max(own.get(w, 0.0), s)
            for e, own in scores.items():
                key, words = self.entries[e]
                if len(own) == len(set(words)):
                    letters = sum(map(len, words))
                    best[key] = max(best.get(key, 0.0), sum(own[w] * len(w) for w in words) / letters)
        return sorted(((s, key) for key, s in best.items() if s >= LEAST_SIMILARITY), key=lambda b: (-b[0], b[1]))[:2]

    def run_together(self, form: str) -> list[tuple[int, str, int, int]]:
        """(edits, letters, rank, id) of all letters of entries that are nearest to those of the value when blanks are ignored, few
        typing errors allowed."""
        letters = form.replace(" ", "")
        most = self.slips(letters)
        near = [(damerau(letters, c, most), c) for c in {c for d in _deletes(letters, most) for c in self.joined.get(d, ())}]
        least = min((n for n, _ in near), default=most + 1)
        return [(n, c, *self.compact[c]) for n, c in near if n == least <= most]

    def guesses(self, value: str, known: Container[str]) -> Guesses:
        """Of a value without clues the entries most like it, and those of nearly the same letters with the form they are near to,
        searched when they are asked for. ``known`` are the words of names of the whole list."""
        return self.similar(value, known), ((f, *c) for f, form in enumerate(forms(value)) for c in self.run_together(form))


def longest_mentions(hits: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, id) of the mentions in a form that do not overlap a longer one, of equally long ones the first; in
    the order in which they stand."""
    kept: list[tuple[int, int, int]] = []
    for hit in sorted(hits, key=lambda h: (-h[1], h[0])):
        if all(hit[0] + hit[1] < k[0] or hit[0] > k[0] + k[1] for k in kept):
            kept.append(hit)
    return sorted(kept)


def settled(clues: Iterable[Clues], every: bool) -> list[int]:
    """Entry that a value means by the clues of all blocks, none without clues: that of its longest mention, or all that are
    mentioned, in their order, by the spelling of the value that has the longest one; or that of the same letters, names first."""
    hits: dict[int, dict[tuple[int, int], int]] = {}
    same: list[tuple[int, int, int]] = []
    for own_hits, own_same in clues:
        for form, start, length, key in own_hits:
            spans = hits.setdefault(form, {})
            spans[start, length] = min(key, spans.get((start, length), key))
        same += map(tuple, own_same)
    if hits:
        found = [longest_mentions((start, length, key) for (start, length), key in hits[form].items()) for form in sorted(hits)]
        best = max(found, key=lambda m: max(length for _, length, _ in m))
        return list(dict.fromkeys(key for _, _, key in best)) if every else [max(best, key=lambda m: (m[1], -m[0]))[2]]
    return [min(same)[2]] if same else []


def guessed(guesses: Iterable[Guesses]) -> list[int]:
    """Entry that a value means by the guesses of all blocks: the most like it, or that of the nearest letters in the first of its
    spellings that has one; none if two entries are equally like or near."""
    guesses = list(guesses)
    like = sorted((b for own, _ in guesses for b in own), key=lambda b: (-b[0], b[1]))
    if like and (len(like) == 1 or like[1][0] < like[0][0]):
        return [like[0][1]]
    near: dict[int, list[tuple[int, str, int, int]]] = {}
    for form, *c in itertools.chain.from_iterable(own for _, own in guesses):
        near.setdefault(form, []).append(tuple(c))
    for form in sorted(near):
        least = min(near[form])[0]
        ids: dict[str, int] = {}
        for n, letters, _, key in sorted(near[form]):
            if n == least:
                ids.setdefault(letters, key)
        if len(set(ids.values())) == 1:
            return [ids.popitem()[1]]
    return []


@functools.lru_cache(maxsize=1)
def _catalog(entries: tuple[tuple[int, str, tuple[str, ...]], ...]) -> Catalog:
    return Catalog(entries)


@functools.lru_cache(maxsize=2)
def matcher(entries: tuple[tuple[int, str, tuple[str, ...]], ...], every: bool = False) -> Callable[[str], list[int]]:
    """Remembering matcher of a whole list of entries, ids of a value; one list per worker process."""
    catalog = _catalog(entries)

    def one(value: str) -> list[int]:
        return settled([catalog.clues(value)], every) or guessed([catalog.guesses(value, catalog.by_word)])

    return functools.lru_cache(maxsize=CACHE_VALUES)(one)


def catalog_blocks(catalog: DataFrame, block: int = BLOCK_ENTRIES) -> Iterator[tuple[tuple[int, str, tuple[str, ...]], ...]]:
    """Entries of a catalog table (skill_id, skill_name, aliases) as blocks of bounded size, collected one after the other."""
    rows = catalog.where("skill_id is not null and skill_name is not null").select("skill_id", "skill_name", "aliases")
    n = rows.count() // block + 1
    part = F.pmod(F.xxhash64("skill_id"), F.lit(n))
    for k in range(n):
        yield tuple(sorted((r.skill_id, r.skill_name, tuple(a for a in r.aliases or () if a)) for r in (rows.where(part == k) if n > 1 else rows).collect()))


def _rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]], *columns: str) -> DataFrame:
    """``_value`` with the columns of ``schema`` that the function of a task makes of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            out = [row(*r) for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_value"), *arrays], names=["_value", *types])

    names = {"string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = {c.split()[0]: names[c.split()[1]] for c in schema.split(", ")}
    return df.mapInArrow(run, f"_value string, {schema}")


def _meanings(values: DataFrame, catalog: DataFrame, value_col: str, every: bool, block: int) -> DataFrame:
    """``values`` with ``_ids``, the entries that ``value_col`` means.

    A catalog of one block is passed over with the values themselves, without a shuffle, and a worker remembers values it has seen.
    Of a larger one each block is collected, passed over the distinct values and what it knows of them written before the next:
    neither the driver nor a worker holds more than a block. What all blocks know of a value settles it, by the rules that hold
    for one block; values without clues are passed over a second time, as a word that any block knows stands for itself.
    """
    blocks = catalog_blocks(catalog, block)
    entries, more = next(blocks), next(blocks, None)
    if more is None:
        at = values.columns.index(value_col)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            meaning = matcher(entries, every)
            for batch in batches:
                found = [meaning(v) if v else [] for v in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "_ids"])

        return values.mapInArrow(run, f"{schema}, _ids array<int>")

    def clues(part: tuple) -> Callable[[], Callable[[str], tuple[str | None]]]:
        def make() -> Callable[[str], tuple[str | None]]:
            own = _catalog(part)

            def row(value: str) -> tuple[str | None]:
                hits, same = own.clues(value)
                # Words matter only to a value that no block has a clue to.
                words = [] if hits or same else own.words(value)
                return (json.dumps((hits, same, words)) if hits or same or words else None,)

            return row

        return make

    def guesses(part: tuple) -> Callable[[], Callable[[str, list[str]], tuple[str | None]]]:
        def make() -> Callable[[str, list[str]], tuple[str | None]]:
            own = _catalog(part)

            def row(value: str, known: list[str]) -> tuple[str | None]:
                like, near = own.guesses(value, known)
                found = like, list(near)
                return (json.dumps(found) if any(found) else None,)

            return row

        return make

    def settle() -> Callable[[list[str]], tuple[list[int], list[str]]]:
        def row(known: list[str]) -> tuple[list[int], list[str]]:
            parts = [json.loads(k) for k in known]
            return settled((p[:2] for p in parts), every), sorted({w for p in parts for w in p[2]})

        return row

    def guess() -> Callable[[list[str]], tuple[list[int]]]:
        return lambda known: (guessed(map(json.loads, known)),)

    def passed(df: DataFrame, parts: Iterable[tuple], make: Callable[[tuple], Callable], *columns: str) -> DataFrame:
        every_part = [cut(_rows(df, "_known string", make(part), *columns).where("_known is not null")) for part in parts if part]
        out = functools.reduce(DataFrame.unionByName, every_part, df.select("_value", F.lit(None).cast("string").alias("_known")))
        return out.groupBy("_value").agg(F.collect_list("_known").alias("_known"))

    typed = cut(values.select(F.col(value_col).alias("_value")).where("_value > ''").distinct())
    first = cut(_rows(passed(typed, itertools.chain((entries, more), blocks), clues, "_value"), "_ids array<int>, _words array<string>", settle, "_known"))
    rest = first.where("size(_ids) = 0").select("_value", "_words")
    second = _rows(passed(rest, catalog_blocks(catalog, block), guesses, "_value", "_words"), "_ids array<int>", guess, "_known")
    best = first.select("_value", "_ids").where("size(_ids) > 0").unionByName(second)
    return values.join(best, F.col(value_col) == F.col("_value"), "left").drop("_value").withColumn("_ids", F.coalesce("_ids", F.expr("cast(array() as array<int>)")))


def map_values(values: DataFrame, catalog: DataFrame, value_col: str = "raw_value", out: str = "skill_id", block: int = BLOCK_ENTRIES) -> DataFrame:
    """``values`` with the id of the entry that ``value_col`` means, 0 where the catalog has none.

    Null and blank values mean no entry. A column that is called ``out`` already is replaced.
    """
    found = _meanings(values.drop(out), catalog, value_col, False, block)
    return found.withColumn(out, F.coalesce(F.try_element_at("_ids", F.lit(1)), F.lit(0))).drop("_ids")


def map_mentions(values: DataFrame, catalog: DataFrame, value_col: str = "raw_value", out: str = "skill_id", block: int = BLOCK_ENTRIES) -> DataFrame:
    """``values`` with a row for each entry that a value mentions, ``place`` from 1 in their order; a value without a mention has one row
    with the entry it is most like, or 0."""
    found = _meanings(values.drop(out, "place"), catalog, value_col, True, block)
    ids = F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(F.array(F.lit(0)))
    return found.select(*[c for c in found.columns if c != "_ids"], F.posexplode(ids).alias("place", out)).withColumn("place", F.col("place") + 1)


def typed_values(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``record_id``, ``field``, ``raw_value``: each distinct non-blank skill as stored, over all rows of a record."""
    parts = [
        df.select(F.col(key).alias("record_id"), F.lit(f"{name}.{col}").alias("field"), F.explode(col).alias("raw_value"))
        for df, name, key, col in (
            (jobs, "job_descriptions", "job_id", "required_skills"),
            (jobs, "job_descriptions", "job_id", "preferred_skills"),
            (profiles, "candidate_profiles", "resume_id", "skills"),
        )
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.where("raw_value rlike '(?U)\\\\S'").distinct()


def mapped_skills(jobs: DataFrame, profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """``p2_found``: every typed value with its ``skill_id``."""
    return map_values(typed_values(jobs, profiles), catalog).select("record_id", "field", "raw_value", "skill_id")


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """Values without an entry: how many records of each field hold each spelling."""
    return mapped.where("skill_id = 0").groupBy("field", "raw_value").agg(F.countDistinct("record_id").alias("records"))


def usage_report(mapped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records of each field that hold each entry of the catalog, 0 included, and the spellings in use."""
    used = mapped.where("skill_id > 0").groupBy("skill_id").agg(F.countDistinct("field", "record_id").alias("records"), F.countDistinct("raw_value").alias("spellings"))
    return catalog.select("skill_id", "skill_name").join(used, "skill_id", "left").select(
        "skill_id", "skill_name", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("spellings", F.lit(0)).alias("spellings")
    )
