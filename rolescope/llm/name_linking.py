"""Variant spellings of names typed by people (problem 6).

Equal names of one scope are one node. Nodes are blocked by phonetic codes of their name parts, the pairs of a block are
compared by Jaro-Winkler and a nickname table, and accepted pairs become people by connected components. A name that
gives only an initial joins the one person it fits best and nobody if two fit alike, so that it never ties two
people together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.versions import latest_rows
from ..session import cut
from .folding import damerau, plain

#: Least Jaro-Winkler similarity of two family names and of two given names, and of either if they are one slip apart.
FAMILY_SIMILARITY, GIVEN_SIMILARITY, SLIP_SIMILARITY = 0.88, 0.86, 0.75
#: Letters of a short family name: these are compared for equality or one swap, and their other part as a family name, since
#: either may be the family name. Likeness of a swapped one.
SHORT, SWAPPED = 3, 0.9
#: Names of one block that are compared pair by pair; a larger block is parted by the letters of the family name.
BLOCK_NAMES = 256
#: Nicknames that the comparison may hold.
MAX_NICKNAMES = 50_000
#: A word of file keys is known as a name's if people's names hold it more often than once in so many of its keys.
KNOWN_SHARE = 20
#: Least keys of a word about the file, least share of them that show a whole name without it, and that hold two parts besides it.
NOISE_KEYS, NOISE_NAMED, NOISE_BESIDE = 3, 0.25, 0.9

# Forms of address and credentials beside names.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir herr frau mme mlle".split())
CREDENTIALS = frozenset("phd dphil md msc bsc mba ma ba cpa cfa pmp jr sr ii iii iv esq rn pe".split())
# Sounds of letters.
_SOUND = {c: str(k) for k, group in enumerate(("bfpvw", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in group}
_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_JOIN = re.compile(r"(?<=\w)[-'’‐‑](?=\w)")
_PART = re.compile(r"[^\W\d_]+")


def name_parts(name: str | None) -> list[str]:
    """Folded parts of a name, family name last where a comma tells it; titles and credentials are left out.

    Parts joined by hyphen or apostrophe are one. Null, blank and wordless names have none.
    """
    if not name:
        return []
    pieces = [_PART.findall(plain(_JOIN.sub("", _BRACKETS.sub(" ", p)))) for p in name.split(",")]
    pieces = [[w for w in p if w not in TITLES] for p in pieces]
    pieces = [p for k, p in enumerate(pieces) if p and not (k and all(w in CREDENTIALS for w in p))]
    if len(pieces) > 1:
        pieces = [[w for p in pieces[1:] for w in p], pieces[0]]
    words = [w for p in pieces for w in p]
    while len(words) > 2 and words[-1] in CREDENTIALS:
        words.pop()
    return words


def sounds(word: str) -> str:
    """Digits of a word's consonants, runs of one sound once."""
    out = []
    last = ""
    for c in word:
        s = _SOUND.get(c, "")
        if s and s != last:
            out.append(s)
        last = s or (last if c in "hw" else "")
    return "".join(out)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    common = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                common.append(x)
                break
    if not common:
        return 0.0
    other = [b[j] for j in range(len(b)) if taken[j]]
    moved = sum(x != y for x, y in zip(common, other, strict=True)) / 2
    m = len(common)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def readings(parts: tuple[str, ...]) -> list[tuple[str, tuple[str, ...]]]:
    """(family name, given names in order) of each way to read the parts: family name last or first, and written in
    two pieces."""
    n = len(parts)
    out = []
    if n >= 2:
        out = [(parts[-1], parts[:-1]), (parts[0], parts[1:])]
    if n >= 3:
        if 3 <= len(parts[-2]) <= 4:
            out.append((parts[-2] + parts[-1], parts[:-2]))
        if 3 <= len(parts[0]) <= 4:
            out.append((parts[0] + parts[1], parts[2:]))
    return [(family, given) for family, given in out if len(family) >= 2]


def alike(a: str, b: str, least: float, most: int) -> float:
    """Jaro-Winkler similarity of two names within ``most`` slips, 0 if it is too small for that many."""
    slips = damerau(a, b, most)
    if slips > most:
        return 0.0
    s = jaro_winkler(a, b)
    return s if s >= (SLIP_SIMILARITY if slips <= 1 else least) else 0.0


class Comparer:
    """Comparison of two names under a nickname table."""

    def __init__(self, nicknames: tuple[tuple[str, str], ...]):
        self.full: dict[str, set[str]] = {}
        for short, name in nicknames:
            self.full.setdefault(plain(short).strip(), set()).add(plain(name).strip())

    def spellings(self, given: str) -> set[str]:
        return {given} | self.full.get(given, set())

    def initials(self, given: str) -> set[str]:
        return {s[0] for s in self.spellings(given)}

    def given(self, a: str, b: str, least: float = GIVEN_SIMILARITY) -> float:
        """2 for the same name, 1 for an initial that fits, 0 otherwise."""
        if a == b:
            return 2
        if len(a) == 1 or len(b) == 1:
            return 1 if self.initials(a) & self.initials(b) and not (len(a) == 1 and len(b) == 1) else 0
        if self.spellings(a) & self.spellings(b):
            return 2
        pairs = [(x, y) for x in self.spellings(a) for y in self.spellings(b) if min(len(x), len(y)) >= 4]
        return 2 if any(alike(x, y, least, 2) for x, y in pairs) else 0

    @staticmethod
    def family(a: str, b: str) -> float:
        if a == b:
            return 1.0
        if min(len(a), len(b)) <= SHORT:
            return SWAPPED if sorted(a) == sorted(b) and damerau(a, b, 1) == 1 else 0.0
        return alike(a, b, FAMILY_SIMILARITY, 1 if min(len(a), len(b)) < 6 else 2)

    def same(self, a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, bool]:
        """(similarity of the family names, whether a given name is only an initial), 0 if the names differ."""
        best = (0.0, True)
        for family_a, given_a in readings(a):
            for family_b, given_b in readings(b):
                s = self.family(family_a, family_b)
                if not s or not best[1] and s <= best[0]:
                    continue
                g = self.given(given_a[0], given_b[0], FAMILY_SIMILARITY if len(family_a) <= SHORT else GIVEN_SIMILARITY)
                if not g:
                    continue
                rest_a, rest_b = given_a[1:], given_b[1:]
                if rest_a and rest_b and not self.given(rest_a[0], rest_b[0]):
                    continue
                # A full name behind an initial is the family name, read wrongly.
                if g == 1 and any(len(given[0]) == 1 and any(len(r) > 1 for r in given[1:]) for given in (given_a, given_b)):
                    continue
                # Full given names say more than initials, whatever the family names' likeness.
                best = max(best, (s, g == 1), key=lambda x: (x[0] > 0, not x[1], x[0]))
        return best if best[0] else (0.0, False)

    def blocks(self, parts: tuple[str, ...]) -> dict[str, str]:
        """Phonetic keys of a name, and the family name each was made of.

        A key holds the sounds of one part and the initial of another, for either order of the parts, so that it does not matter
        how they are ordered: the first, the last, and the outer sounds, so that a slip anywhere leaves one of them; of short family
        names, the letters in any order."""
        out = {}
        for family, given in readings(parts):
            for initial in self.initials(given[0]):
                if len(family) <= SHORT:
                    out[f"#{initial}{''.join(sorted(family))}"] = family
                    continue
                code = sounds(family)
                for key in (f"<{initial}{code[:3]}", f">{initial}{code[-3:]}", f"={initial}{code[:1]}{code[-2:]}", f"~{initial}{code[:2]}{code[-1:]}"):
                    out[f"{key}|{family}" if key in out and out[key] != family else key] = family
        return out


def spellings_near(family: str) -> set[str]:
    """A family name with as many letters left out as a likely other spelling may have slips, all ways: two names within that
    many slips have one of these in common."""
    out = level = {family}
    for _ in range(1 if len(family) < 5 else 2):
        level = {w[:k] + w[k + 1 :] for w in level for k in range(len(w))}
        out = out | level
    return out


@functools.lru_cache(maxsize=4)
def comparer(nicknames: tuple[tuple[str, str], ...]) -> Comparer:
    return Comparer(nicknames)


def nickname_pairs(nicknames: DataFrame) -> tuple[tuple[str, str], ...]:
    """The nickname table, null entries left out; ValueError beyond the documented size."""
    rows = nicknames.where("nickname is not null and given_name is not null").select("nickname", "given_name").limit(MAX_NICKNAMES + 1).collect()
    if len(rows) > MAX_NICKNAMES:
        raise ValueError(f"more than {MAX_NICKNAMES} nicknames")
    return tuple(sorted((r.nickname, r.given_name) for r in rows))


def parsed(records: DataFrame) -> DataFrame:
    """``records`` (id, scope, name, is_file) with ``parts`` in place of the name; records without parts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [" ".join(name_parts(n)) for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.string()), batch.column(3)], names=["id", "scope", "parts", "is_file"])

    return records.select("id", "scope", "name", "is_file").mapInArrow(run, "id string, scope string, parts string, is_file boolean").where("parts <> ''")


def without_noise(names: DataFrame, nicknames: tuple[tuple[str, str], ...]) -> DataFrame:
    """``names`` (id, scope, parts, is_file) without the words that file keys hold besides a name.

    A word of a key is known if people's names hold it, more often than once in ``KNOWN_SHARE`` keys, or the nickname table
    does. A key shows a name without its unknown words if two known parts are left and one of them is mostly a family
    name. An unknown word is about the file if a share of its keys does so (``NOISE_NAMED``) and nearly all of them that
    hold a known part hold two parts besides it (``NOISE_BESIDE``): shares do not grow with the table, and beside a family name stand given names only.
    Where fewer than two parts would be left, a key stays as it is; a key of nothing but such words names nobody.
    """
    spark = names.sparkSession
    keys = names.where("is_file")
    at = keys.select("id", F.posexplode(F.split("parts", " ")).alias("at", "word"))
    part = F.split("parts", " ")
    in_names = names.where("not is_file and parts like '% %'").select(part.alias("w")).select(F.posexplode("w").alias("at", "word"), (F.size("w") - 1).alias("end"))
    table = sorted({plain(w).strip() for pair in nicknames for w in pair})
    counted = (
        at.select("word", F.lit(1).alias("key"), F.lit(0).alias("name"), F.lit(0).alias("last"), F.lit(False).alias("listed"))
        .unionByName(in_names.select("word", F.lit(0).alias("key"), F.lit(1).alias("name"), (F.col("at") == F.col("end")).cast("int").alias("last"), F.lit(False).alias("listed")))
        .unionByName(spark.createDataFrame([(w,) for w in table], "word string").select("word", F.lit(0).alias("key"), F.lit(0).alias("name"), F.lit(0).alias("last"), F.lit(True).alias("listed")))
        .groupBy("word").agg(F.sum("key").alias("key"), F.sum("name").alias("name"), F.sum("last").alias("last"), F.max("listed").alias("listed"))
        .where("key > 0")
        .select("word", (F.col("listed") | (F.col("name") * KNOWN_SHARE > F.col("key")) | (F.length("word") == 1)).alias("known"), ((F.col("last") * 2 > F.col("name")) & (F.length("word") > 1)).alias("family"))
    )
    read = at.join(counted, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word", "known", "family"))).alias("w"))
    read = cut(read.withColumn("named", F.expr("size(filter(w, x -> x.known)) >= 2 and exists(w, x -> x.known and x.family)")))
    unknown = read.select("named", F.expr("size(w) > 2 or not exists(w, x -> x.known)").alias("beside"), F.explode(F.expr("array_distinct(transform(filter(w, x -> not x.known), x -> x.word))")).alias("word"))
    noise = (
        unknown.groupBy("word").agg(F.count("*").alias("keys"), F.sum(F.col("named").cast("int")).alias("named"), F.sum(F.col("beside").cast("int")).alias("beside"))
        .where((F.col("keys") >= NOISE_KEYS) & (F.col("named") >= NOISE_NAMED * F.col("keys")) & (F.col("beside") >= NOISE_BESIDE * F.col("keys"))).select("word", F.lit(True).alias("noise"))
    )
    words = read.select("id", F.explode("w").alias("x")).select("id", "x.at", "x.word").join(noise, "word", "left")
    kept = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("noise", F.lit(False)).alias("noise")))).alias("w"))
    kept = kept.withColumn("named", F.expr("filter(w, x -> not x.noise)")).where("size(named) > 0")
    kept = kept.select("id", F.array_join(F.expr("transform(if(size(named) >= 2, named, w), x -> x.word)"), " ").alias("kept"))
    cleaned = keys.join(kept, "id").select("id", "scope", F.col("kept").alias("parts"), "is_file")
    return names.where("not is_file").unionByName(cleaned)


def candidate_pairs(nodes: DataFrame, nicknames: tuple[tuple[str, str], ...], block_names: int = BLOCK_NAMES) -> DataFrame:
    """``a``, ``b`` with ``pa``, ``pb``: each pair of nodes (node, scope, parts) that share a block, once.

    Blocks are counted. One of more than ``block_names`` names is parted by ``spellings_near`` of the family name: every pair
    that the comparison accepts stays together, and what remains in one place are names whose family names are spelled alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = comparer(nicknames)
        for batch in batches:
            at, keys, families = [], [], []
            for i, (scope, parts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for key, family in own.blocks(tuple(parts.split(" "))).items():
                    at.append(i)
                    keys.append(f"{scope}\x00{key.partition('|')[0]}")
                    families.append(family)
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(2).take(where), pa.array(keys, pa.string()), pa.array(families, pa.string())], names=["node", "parts", "block", "family"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, (block, family) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for key in [family] if len(family) <= SHORT else spellings_near(family):
                    at.append(i)
                    keys.append(f"{block}\x00{key}" if len(family) > SHORT else block)
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(keys, pa.string())], names=["node", "parts", "block"])

    keyed = nodes.select("node", "scope", "parts").mapInArrow(run, "node string, parts string, block string, family string")
    large = keyed.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > block_names).select("block")
    every = keyed.select("node", "parts", "block")
    if not large.isEmpty():
        large = cut(large)
        parted = keyed.join(large, "block", "left_semi").select("node", "parts", "block", "family").mapInArrow(part, "node string, parts string, block string")
        every = keyed.join(large, "block", "left_anti").select("node", "parts", "block").unionByName(parted)
    left = every.select("block", F.col("node").alias("a"), F.col("parts").alias("pa"))
    right = every.select("block", F.col("node").alias("b"), F.col("parts").alias("pb"))
    return left.join(right, "block").where("a < b").select("a", "b", "pa", "pb").distinct()


def compared(pairs: DataFrame, nicknames: tuple[tuple[str, str], ...]) -> DataFrame:
    """``a``, ``b``, ``score``, ``weak`` of the pairs whose names agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = comparer(nicknames).same
        for batch in batches:
            results = [same(tuple(x.split(" ")), tuple(y.split(" "))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            good = pa.array([i for i, r in enumerate(results) if r[0] > 0], pa.int32())
            kept = [r for r in results if r[0] > 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(good), batch.column(1).take(good), pa.array([round(r[0], 6) for r in kept], pa.float64()), pa.array([r[1] for r in kept], pa.bool_())],
                names=["a", "b", "score", "weak"],
            )

    return pairs.mapInArrow(run, "a string, b string, score double, weak boolean")


def people(records: DataFrame, nicknames: DataFrame, block_names: int = BLOCK_NAMES) -> DataFrame:
    """``id``, ``scope`` and ``person`` of each record with a name of two parts or more.

    ``records`` has id (unique), scope, name, is_file. A null scope is a scope of its own for each record. Null and
    blank names, and single words, belong to nobody. Names that are equal once folded are always one person.
    """
    table = nickname_pairs(nicknames)
    scoped = records.withColumn("scope", F.coalesce("scope", F.concat(F.lit("\x00"), "id")))
    named = without_noise(cut(parsed(scoped)), table).where("parts like '% %'")
    firsts = named.groupBy("scope", "parts").agg(F.min("id").alias("node"))
    by_name = cut(named.join(firsts, ["scope", "parts"]).select("id", "scope", "parts", "node"))
    nodes = by_name.select("node", "scope", "parts").distinct()
    edges = cut(compared(candidate_pairs(nodes, table, block_names), table))

    sure = connected_components(edges.where("not weak"), "a", "b")
    group = nodes.select("node").join(sure, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    weak = edges.where("weak").select("a", "b", "score")
    ends = weak.join(group.withColumnsRenamed({"node": "a", "component": "ca"}), "a").join(group.withColumnsRenamed({"node": "b", "component": "cb"}), "b")
    both = ends.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "score").unionByName(ends.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "score"))
    # An initial leaves its group's full names open: such groups look for the full names they fit.
    short = group.join(nodes, "node").groupBy("component").agg(F.min(F.expr("exists(split(parts, ' '), x -> length(x) = 1) and size(filter(split(parts, ' '), x -> length(x) > 1)) = 1").cast("int")).alias("short"))
    fits = (
        both.join(short.where("short = 1").select(F.col("component").alias("c")), "c", "left_semi")
        .join(short.where("short = 0").select(F.col("component").alias("to")), "to", "left_semi")
        .groupBy("c", "to").agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("c")
    chosen = (
        fits.withColumn("top", F.max("score").over(best)).where("score = top")
        .withColumn("n", F.count("*").over(best)).where("n = 1").select("c", "to")
    )
    person = group.join(chosen, group.component == chosen.c, "left").select("node", F.coalesce("to", "component").alias("person"))
    return by_name.select("id", "scope", "node").join(person, "node").select("id", "scope", "person")


def applicant_records(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Records of both tables: latest row of each id; the scope is the intake folder of the record's path.

    A file key of one word whose stem writes it with inner capitals is parted there.
    """
    folder = F.element_at(F.split(F.col("path"), "/"), -2)
    p = latest_rows(profiles.select(F.col("resume_id").alias("id"), F.col("source_path").alias("path"), "name", "updated_at").where("id is not null"), ["id"], "updated_at", [F.col("name").asc_nulls_last()])
    f = files.select(F.col("file_id").alias("id"), F.col("relative_path").alias("path"), F.trim("candidate_key").alias("key"), "stem", "modified_at").where("id is not null")
    f = latest_rows(f, ["id"], "modified_at", [F.col("key").asc_nulls_last()])
    at = F.expr("instr(lower(stem), lower(key))")
    written = F.when((at > 0) & ~F.col("key").contains(" "), F.expr("regexp_replace(substring(stem, instr(lower(stem), lower(key)), length(key)), '(\\\\p{Ll})(\\\\p{Lu})', '$1 $2')"))
    f = f.withColumn("name", F.coalesce(written, F.col("key")))
    part = lambda df, is_file: df.where("length(path) > 0 and instr(path, '/') > 0").select("id", folder.alias("scope"), "name", F.lit(is_file).alias("is_file"))
    return part(p, False).unionByName(part(f, True))


def linked_pairs(linked: DataFrame) -> DataFrame:
    """``left_id``, ``right_id`` (smaller first) of each pair of records of one person."""
    left = linked.select("person", F.col("id").alias("left_id"))
    right = linked.select("person", F.col("id").alias("right_id"))
    return left.join(right, "person").where("left_id < right_id").select("left_id", "right_id")


def link_applicants(profiles: DataFrame, files: DataFrame, nicknames: DataFrame) -> DataFrame:
    return people(applicant_records(profiles, files), nicknames)
