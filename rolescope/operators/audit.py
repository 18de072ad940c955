"""Audit of file names for likely duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..session import cut, parallelism, written
from .components import connected_components


def file_features(files: DataFrame) -> DataFrame:
    """Name features of files (relative_path, size_bytes): one row for each path, the largest of repeated rows.

    ``idx`` numbers nothing globally: pairs are ordered by path, so no global sort is needed.
    """
    rows = files.where("relative_path is not null").groupBy("relative_path").agg(F.max("size_bytes").alias("size_bytes"))
    path = F.col("relative_path")
    named = rows.withColumn("stem", text.stem(path)).withColumn("suffix", F.regexp_extract(text.basename(path), r"(?<=.)(\.[^.]+)$", 1))
    stem = F.col("stem")
    return named.select(
        "relative_path", "size_bytes", "stem", "suffix", F.lower("suffix").alias("suffix_lower"), text.sanitised_id(stem).alias("sanitized_id"), F.lower("stem").alias("stem_lower"),
        text.compact(stem).alias("stem_compact"), F.array_join(text.marker_tokens(stem), " ").alias("marker_base"), F.array_join(text.marker_tokens(stem), "").alias("marker_compact"),
        text.person_tokens(stem).alias("tokens"), F.array_join(text.person_tokens(stem), " ").alias("candidate_key"), F.array_join(text.person_tokens(stem), "").alias("candidate_compact"),
        text.is_template(stem).alias("is_template"), text.is_informative(text.person_tokens(stem)).alias("is_informative"),
    )


#: Duplicate rules: key column, and the condition on a group of two or more files that share it.
RULES = {
    "same stem": ("stem", None),
    "same id": ("sanitized_id", None),
    "extension only": ("stem", lambda: F.count_distinct("suffix_lower") > 1),
    "case only": ("stem_lower", lambda: F.count_distinct("stem") > 1),
    "marker": ("marker_compact", lambda: (F.count_distinct("stem_lower") > 1) & F.bool_or(F.col("marker_compact") != F.col("stem_compact"))),
}


def groups(features: DataFrame, rule: str) -> DataFrame:
    """``rule``, ``key`` and ``files`` (how many) of each group of a rule; empty and null keys form no group."""
    key, having = RULES[rule]
    keyed = features.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("key"))
    out = keyed.agg(F.count("*").alias("files"), (having() if having else F.lit(True)).alias("ok"))
    return out.where("files > 1 and ok").select(F.lit(rule).alias("rule"), "key", "files")


def group_members(features: DataFrame, rule: str) -> DataFrame:
    """Files of each group of a rule, one a row, numbered by lower-cased path."""
    key, _ = RULES[rule]
    own = groups(features, rule)
    w = Window.partitionBy("rule", "key").orderBy(F.lower("relative_path"), "relative_path")
    return features.withColumn("key", F.col(key)).join(own.drop("files"), "key").select("rule", "key", "relative_path", F.row_number().over(w).alias("member"))


def totals(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("total_files"), F.countDistinct("stem").alias("unique_stems"), F.countDistinct("sanitized_id").alias("unique_ids"))


def rule_links(features: DataFrame) -> DataFrame:
    """``left``, ``right``, ``reason``: each file linked to the first file of its group, for every rule that counts as
    evidence. A group of n files makes n - 1 links, and they connect it as all its pairs would."""
    frames = []
    for rule, reason in (("same id", "same sanitized id"), ("extension only", "same stem, other extension"), ("case only", "same stem ignoring case"), ("marker", "same marker-stripped base")):
        key, _ = RULES[rule]
        own = groups(features, rule)
        if rule == "marker":
            fit = features.groupBy(F.col(key).alias("key")).agg(F.bool_or("is_template").alias("t"), F.bool_or("is_informative").alias("i"))
            own = own.join(fit.where("not t and i").select("key"), "key", "left_semi")
        frames.append(features.withColumn("key", F.col(key)).join(own.select("key"), "key", "left_semi").select("key", "relative_path", F.lit(reason).alias("reason")))
    same = features.where("candidate_compact <> ''").groupBy(F.col("candidate_compact").alias("key")).agg(F.count("*").alias("n"), F.bool_or("is_template").alias("t"), F.bool_and("is_informative").alias("i"))
    people = features.withColumn("key", F.col("candidate_compact")).join(same.where("n > 1 and not t and i").select("key"), "key", "left_semi")
    frames.append(people.select("key", "relative_path", F.lit("same candidate key").alias("reason")))
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    # The least path of a group is found by partial minima and joined back: no group is gathered in one task.
    first = every.groupBy("reason", "key").agg(F.min("relative_path").alias("left"))
    return every.join(first, ["reason", "key"]).where("left <> relative_path").select("left", F.col("relative_path").alias("right"), "reason").distinct()


#: Similarity that letters alone must reach, and the sum of two keys' lengths from which segments are looked up, not letters.
ALIKE, LONG = 0.92, 50
LETTERS, FREQUENT = "abcdefghijklmnopqrstuvwxyz0123456789", "aeiorlnstdhmu"


def _spare(total: Column) -> Column:
    """Letters of both keys that may be left over in a pair of ``total`` letters; similarities count as rounded to six decimals."""
    return F.floor(total * (1 - ALIKE + 5e-7)).cast("int")


def _met(short: DataFrame, long: DataFrame, on: list[str], where: str = "true") -> DataFrame:
    both = short.join(long, on).where("a <> b").where(where)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _by_words(people: DataFrame, gap: int, few: int = 12) -> DataFrame:
    """Pairs of people whose word sets may share three quarters of the smaller one, and whose keys begin with the same letter.

    Such pairs share all words of one or two, else three words among the rarest of the smaller set; only these are looked up,
    so words that many keys hold, such as those of an occupation, bring no pairs together. Sets of more than ``few`` words
    are looked up by two words.
    """
    words = people.select("id", "c", "n", F.explode("ws").alias("w"))
    frequency = words.groupBy("w").agg(F.count("*").alias("f"))
    ordered = words.join(frequency, "w").groupBy("id", "c", "n").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("x")).withColumn("ws", F.col("x.w"))
    size = F.size("ws")
    each = lambda ws, p, f: F.flatten(F.transform(F.filter(ws, lambda q: q > p), f))
    one = F.transform("ws", lambda p: F.xxhash64("c", p))
    two = lambda ws, mark: each(ws, F.lit(""), lambda p: F.transform(F.filter(ws, lambda q: q > p), lambda q: F.xxhash64("c", p, q, F.lit(mark))))
    three = lambda ws: each(ws, F.lit(""), lambda p: each(ws, p, lambda q: F.transform(F.filter(ws, lambda r: r > q), lambda r: F.xxhash64("c", p, q, r))))
    rare = lambda n: F.slice("ws", F.lit(1), (size - F.ceil(size * 0.75) + n).cast("int"))
    of_small = F.when(size == 1, one).when(size == 2, F.concat(two(rare(2), 0), two(rare(2), 1))).when(size > few, two(rare(2), 1)).otherwise(F.concat(three(rare(3)), two(rare(2), 1)))
    of_other = F.when(size > few, F.concat(one, two(F.col("ws"), 1))).otherwise(F.concat(one, two(F.col("ws"), 0), three(F.col("ws"))))
    small = ordered.select(F.col("id").alias("a"), F.col("n").alias("na"), size.alias("sa"), F.explode(of_small).alias("h"))
    other = ordered.select(F.col("id").alias("b"), F.col("n").alias("nb"), size.alias("sb"), F.explode(of_other).alias("h"))
    return _met(small, other, ["h"], f"sa <= sb and abs(na - nb) <= {gap}")


def _by_letters(people: DataFrame) -> DataFrame:
    """Pairs of people whose keys begin with the same letter, have fewer than ``LONG`` letters together and may be ``ALIKE``.

    At most three letters are left over: none or one of the shorter key and one to three of the longer. So the letters
    of both, whatever their order, become equal if one is taken from the shorter or added to it, and one or two are taken from the
    longer. What is added is a frequent letter, or two rare ones are taken instead; only from 38 letters on, where three may be
    left over, any letter is added and any two are taken. Letters are looked up as a sum of their hashes.
    """
    value = lambda x: F.xxhash64(x).bitwiseAND(2**48 - 1)
    every = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring("k", i, 1))
    summed = F.aggregate(every, F.shiftleft(F.ascii("c").cast("long"), 55), lambda s, x: s + value(x))
    keys = people.where(f"n between 6 and {LONG // 2 + 1}").select("id", "n", summed.alias("h"), F.array_distinct(every).alias("x"))
    h, n, x = F.col("h"), F.col("n"), F.col("x")
    listed = lambda letters: F.array(*(F.lit(c) for c in letters))
    none = F.expr("cast(array() as array<bigint>)")
    least = lambda size, values: F.when(n >= size, values).otherwise(none)
    taken = F.transform(x, lambda p: h - value(p))
    added = F.transform(F.when(n < 18, listed(FREQUENT)).otherwise(listed(LETTERS)), lambda p: h + value(p))
    some = F.when(n < 20, F.array_except(x, listed(FREQUENT))).otherwise(x)
    twice = F.flatten(F.transform(some, lambda p: F.transform(F.filter(some, lambda q: q >= p), lambda q: h - value(p) - value(q))))
    short = keys.where(f"n < {LONG // 2}").select(F.col("id").alias("a"), F.explode(F.concat(F.array(h), least(13, taken), least(12, added))).alias("h"))
    long = keys.select(F.col("id").alias("b"), F.explode(F.concat(taken, least(14, twice))).alias("h"))
    return _met(short, long, ["h"])


def _marks(k: str) -> Column:
    """64 bits of the letters that a key holds once, twice and three times; taking or adding a letter changes one bit at most."""
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.substring(k, i, 1)))
    times = lambda p: F.length(k) - F.length(F.replace(F.col(k), p))
    place = lambda p, j: F.when(j < 3, F.ascii(p) % 26 + (j - 1) * 26).otherwise(F.ascii(p) % 12 + 52)
    bits = F.flatten(F.transform(letters, lambda p: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), times(p))), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), place(p, j)))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def _by_segment(people: DataFrame, gap: int) -> DataFrame:
    """Pairs of people whose keys begin with the same letter, have ``LONG`` letters or more together and may be ``ALIKE``.

    Strings so alike differ in few letters: cut the shorter into one segment more than that, and one segment stands in
    the longer at nearly the same place. Segments are looked up by text, place and the shorter's length; of those that
    meet, only pairs whose letters differ in no more are kept.
    """
    keys = people.where(f"2 * n + {gap} >= {LONG}").select("id", "k", "c", "n", _marks("k").alias("m"))
    # The shorter string has n letters and the longer at most n + gap.
    spare = lambda n: _spare(n * 2 + gap)
    bounds = lambda n: F.transform(F.sequence(F.lit(0), spare(n)), lambda i: F.struct(i.alias("i"), F.floor(i * n / (spare(n) + 1)).cast("int").alias("f"), F.floor((i + 1) * n / (spare(n) + 1)).cast("int").alias("t")))
    place = lambda n, seg: F.xxhash64("c", n, "s.i", seg)
    short = keys.withColumn("s", F.explode(bounds(F.col("n")))).where("s.f < s.t").select(F.col("id").alias("a"), F.col("m").alias("ma"), spare(F.col("n")).alias("most"), place("n", F.expr("substring(k, s.f + 1, s.t - s.f)")).alias("h"))
    lengths = F.sequence(F.greatest(F.lit(1), F.lit(LONG) - F.col("n"), F.col("n") - gap), F.col("n"))
    shifted = keys.where(f"2 * n >= {LONG}").withColumn("na", F.explode(lengths)).withColumn("s", F.explode(bounds(F.col("na")))).withColumn("d", F.explode(F.sequence(-spare(F.col("na")), spare(F.col("na")))))
    inside = shifted.where("s.f < s.t and s.f + d >= 0 and s.t + d <= n")
    long = inside.select(F.col("id").alias("b"), F.col("m").alias("mb"), place("na", F.expr("substring(k, s.f + d + 1, s.t - s.f)")).alias("h")).distinct()
    return _met(short, long, ["h"], "bit_count(ma ^ mb) <= most")


def near_people(people: DataFrame, gap: int) -> DataFrame:
    """``a`` and ``b``, the lesser first: ids of people (id, key, k, ws, c, n) that three filters bring together, all that can be near."""
    return _by_words(people, gap).unionByName(_by_letters(people)).unionByName(_by_segment(people, gap)).distinct()


def person_keys(usable: DataFrame) -> DataFrame:
    """Distinct ``candidate_key`` with ``id`` (its hash), ``k`` (without blanks), ``ws`` (distinct words), ``c`` (first letter) and ``n`` (letters)."""
    k = F.replace(F.col("candidate_key"), F.lit(" "))
    keys = usable.select("candidate_key").distinct().repartition(parallelism(usable.sparkSession))
    return keys.select(F.xxhash64("candidate_key").alias("id"), F.col("candidate_key").alias("key"), k.alias("k"), F.array_distinct(F.split("candidate_key", " ")).alias("ws"), F.substring(k, 1, 1).alias("c"), F.length(k).alias("n"))


def near_links(features: DataFrame, most_length_gap: int = 4) -> DataFrame:
    """``left``, ``right``, ``similarity``, ``reason`` of files whose person keys are alike.

    Keys begin with the same letter, their lengths are near, and either their words overlap or their letters do.
    Distinct keys are compared, and files are joined to those found. Candidates come from lossless filters, rare shared
    words, letters but for the few left over, and segments of long keys, not from all pairs of a letter. The
    similarity is that of matching blocks, asymmetric in its arguments; the left file is the first by path. Files with
    equal keys belong to ``rule_links``.
    """
    files = written(features.where("is_informative and not is_template and candidate_compact <> ''").select("relative_path", "size_bytes", "candidate_key"), "audit-files")
    people = written(person_keys(files), "audit-people")
    side = lambda name: people.select(*(F.col(c).alias(f"{name}{'_' * (c != 'id')}{c if c != 'id' else ''}") for c in people.columns))
    a, b = F.col("a_k"), F.col("b_k")
    pairs = (
        near_people(people, most_length_gap).join(side("a"), "a").join(side("b"), "b").where((a != b) & (F.col("a_c") == F.col("b_c")) & (F.abs(F.col("a_n") - F.col("b_n")) <= most_length_gap))
        .withColumn("overlap", scoring.token_overlap(F.col("a_ws"), F.col("b_ws")) >= 0.75).withColumn("contains", a.contains(b) | b.contains(a))
        .where(F.col("overlap") | (F.levenshtein(a, b) <= _spare(F.col("a_n") + F.col("b_n"))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
            values = [pa.array([similarity(x, y) for x, y in own], pa.float64()) for own in (texts, [(y, x) for x, y in texts])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *values], names=["a_key", "b_key", "overlap", "contains", "forth", "back"])

    scored = pairs.select("a_key", "b_key", "overlap", "contains", "a_k", "b_k").mapInArrow(run, "a_key string, b_key string, overlap boolean, contains boolean, forth double, back double")
    file = lambda name: files.select(F.col("candidate_key").alias(f"{name}_key"), F.col("relative_path").alias(f"{name}_path"), F.col("size_bytes").alias(f"{name}_size"))
    met = scored.where((F.greatest("forth", "back") >= ALIKE) | F.col("overlap")).join(file("a"), "a_key").join(file("b"), "b_key").select(
        F.least("a_path", "b_path").alias("left"), F.greatest("a_path", "b_path").alias("right"), F.when(F.col("a_path") < F.col("b_path"), F.col("forth")).otherwise(F.col("back")).alias("similarity"),
        "overlap", "contains", scoring.size_ratio(F.col("a_size"), F.col("b_size")).alias("ratio"),
    )
    near = (F.col("similarity") >= ALIKE) & (F.col("overlap") | F.col("contains") | (F.col("ratio") >= 0.7))
    token = F.col("overlap") & ((F.col("similarity") >= 0.84) | (F.col("ratio") >= 0.85) | F.col("contains"))
    reason = F.concat_ws(
        ", ", F.lit("similar name"), F.format_string("similarity=%.2f", "similarity"), F.when(F.col("overlap"), "token overlap"),
        F.when(F.col("ratio") >= 0.7, F.format_string("size_ratio=%.2f", "ratio")), F.when(F.col("contains"), "one contains the other"),
    )
    return met.where(near | token).select("left", "right", "similarity", reason.alias("reason"))


def similarity(a: str, b: str) -> float:
    """Ratio of matching blocks of two strings, rounded to six decimals; upper bounds spare most full comparisons."""
    m = SequenceMatcher(None, a, b)
    if m.real_quick_ratio() < 0.5 or m.quick_ratio() < 0.5:
        return round(m.quick_ratio(), 6)
    return round(m.ratio(), 6)


def review_groups(features: DataFrame) -> DataFrame:
    """``group`` (its first path), ``relative_path``, ``group_size`` and ``reasons`` of each file that some evidence links
    to another. Evidence is transitive: a group is a connected component of all links."""
    links = cut(rule_links(features).unionByName(near_links(features).select("left", "right", "reason")))
    linked = connected_components(links, "left", "right")
    reasons = links.join(linked, links.left == linked.node).groupBy("component").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    sizes = linked.groupBy("component").agg(F.count("*").alias("group_size"))
    return linked.join(sizes, "component").join(reasons, "component").select(F.col("component").alias("group"), F.col("node").alias("relative_path"), "group_size", "reasons")


def report(features: DataFrame) -> DataFrame:
    """Lines of a Markdown report, ``line_no`` and ``line``: totals, then each rule's groups, then the review groups.

    Lines are rows and stay distributed; a writer sorts them by ``line_no``.
    """
    t = totals(features)
    head = t.select(F.posexplode(F.array(F.lit("# File audit"), F.format_string("- files: %d", "total_files"), F.format_string("- distinct stems: %d", "unique_stems"), F.format_string("- distinct ids: %d", "unique_ids"))).alias("k", "line")).select(F.format_string("0-%03d", "k").alias("line_no"), "line")
    parts = [head]
    for n, rule in enumerate(RULES, 1):
        members = group_members(features, rule)
        parts.append(members.select(F.concat(F.lit(f"{n}-"), "key", F.lit("-"), F.format_string("%06d", "member")).alias("line_no"), F.concat(F.lit(f"- {rule} `"), "key", F.lit("`: "), "relative_path").alias("line")))
    review = review_groups(features)
    parts.append(review.select(F.concat(F.lit("9-"), "group", F.lit("-"), "relative_path").alias("line_no"), F.concat(F.lit("- review `"), "group", F.lit("`: "), "relative_path", F.lit(" ("), F.array_join("reasons", "; "), F.lit(")")).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
