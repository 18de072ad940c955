"""Text expressions: columns in, columns out, all inside the JVM. Null text gives null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def strip(c: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of two or more blanks as one, none at the ends."""
    return strip(F.regexp_replace(c, r"\s{2,}", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalised(c: Column) -> Column:
    """Extracted text in one form: one bullet glyph, line feeds only, no tabs, lines stripped, blank lines single."""
    glyphs = "‣▪"
    c = F.translate(c, glyphs + " \f", "••••" + " \n")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, "\t", "    ")
    c = F.regexp_replace(c, r"[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_bullet(c: Column, bullets: str = lexicon.BULLETS) -> Column:
    """Line without leading list glyphs and blanks, stripped."""
    return strip(F.regexp_replace(c, rf"^[{bullets.replace('-', '')}\-\s]+", ""))


def heading_form(c: Column) -> Column:
    """Letters, digits and single blanks of a line in small letters, without its list glyph."""
    return F.trim(F.regexp_replace(F.lower(strip_bullet(c)), r"[^a-z0-9]+", " "))


def section_of(c: Column, sections: dict[str, tuple[str, ...]] = lexicon.SECTIONS, longest: int = lexicon.LONGEST_HEADING) -> Column:
    """Section that a line opens, null for other lines. Sections are tried in order; a heading is an alias, or holds an
    alias all of whose words are words of the line."""
    form = heading_form(c)
    words = F.split(form, " ")

    def opened(aliases: tuple[str, ...]) -> Column:
        held = [(form == a) | (form.contains(a) & (F.size(F.array_except(F.split(F.lit(a), " "), words)) == 0)) for a in aliases]
        return reduce(lambda x, y: x | y, held)

    found = F.coalesce(*(F.when(opened(aliases), F.lit(name)) for name, aliases in sections.items()))
    return F.when((form != "") & (F.length(form) <= longest), found)


def feature_form(c: Column) -> Column:
    """Text for matching: small letters, digits and +, single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9+]+", " "))


def token_set(c: Column, stopwords: tuple[str, ...] = lexicon.STOPWORDS) -> Column:
    """Distinct words of a text but for stop words; an empty array for null and wordless texts."""
    words = F.array_distinct(F.split(feature_form(F.coalesce(c, F.lit(""))), " "))
    return F.array_except(words, F.array(*(F.lit(w) for w in ("", *stopwords))))


def primary_email(c: Column) -> Column:
    """First e-mail address in small letters; null without one."""
    return F.lower(F.nullif(F.regexp_extract(c, "(?U)" + lexicon.EMAIL, 0), F.lit("")))


def primary_phone(c: Column) -> Column:
    """First number of 10 to 15 digits, digits only, with a leading + if written so; null without one."""
    found = F.regexp_extract_all(c, F.lit(f"({lexicon.PHONE})"), 1)
    digits = F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(10, 15))
    first = F.get(digits, F.lit(0))
    return F.concat(F.when(first.startswith("+"), "+").otherwise(""), F.regexp_replace(first, r"\D", ""))


def lexicon_hits(c: Column, lexicon_map: dict[str, str] = lexicon.SKILLS, last_alias_only: bool = True) -> Column:
    """Canonical names of the entries that occur as whole words, case ignored, sorted. ``last_alias_only`` scans one
    alias for each name, the last given; otherwise all.

    One pass over the text whatever the size of the lexicon: at each place where a word begins the longest alias is taken, and
    the shorter ones that it begins with are known beforehand.
    """
    chosen = {name: [alias.lower()] for alias, name in lexicon_map.items()} if last_alias_only else {}
    if not last_alias_only:
        for alias, name in lexicon_map.items():
            chosen.setdefault(name, []).append(alias.lower())
    names: dict[str, set[str]] = {}
    for name, aliases in chosen.items():
        for alias in aliases:
            names.setdefault(alias, set()).add(name)
    if not names:
        return F.when(c.isNotNull(), F.expr("cast(array() as array<string>)"))
    begun = {a: sorted({n for b in names for n in names[b] if a == b or a.startswith(b) and not (a[len(b)].isalnum() or a[len(b)] == "_")}) for a in names}
    special = r"\.+*?()[]{}^$|#-"
    quoted = "|".join("".join("\\" + x if x in special else x for x in a) for a in sorted(names, key=lambda a: (-len(a), a)))
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)(?<!\w)(?=({quoted})(?!\w))"), 1))
    table = F.create_map(*(x for a, own in begun.items() for x in (F.lit(a), F.array(*map(F.lit, own)))))
    hits = F.array_distinct(F.flatten(F.transform(found, lambda a: table[a])))
    return F.array_sort(hits, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def skill_candidates(c: Column) -> Column:
    """Parts of a line of skills: what follows its first colon, split at commas, slashes, bars and the word and."""
    payload = F.when(c.contains(":"), F.regexp_replace(c, r"^[^:]*:", "")).otherwise(c)
    parts = F.split(payload, r"(?i)[,/|]|\s+\band\b\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ .;:-]+|[ .;:-]+$", "")), lambda p: p != "")


def sanitised_id(c: Column) -> Column:
    """Identifier made of letters, digits, - and _; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "-"), "^[-_]+|[-_]+$", ""), F.lit(""))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, r"[/\\]"), -1)


def stem(c: Column) -> Column:
    """File name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def suffix(c: Column) -> Column:
    """Last suffix with its dot, in small letters; empty without one."""
    return F.lower(F.regexp_extract(basename(c), r"(?<=.)(\.[^.]+)$", 1))


def split_name(c: Column, aliases: dict[str, str] = lexicon.SPLITS, strict: bool = True) -> Column:
    """Canonical split; null for null and blank; an unknown split is an error, or null unless ``strict``."""
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    key = F.lower(blank_to_null(c))
    if not strict:
        return known[key]
    return F.when(key.isNull(), F.lit(None)).when(known[key].isNotNull(), known[key]).otherwise(F.raise_error(F.concat(F.lit("unsupported split: "), key)))


def strip_list_prefix(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), "^-", ""))


# ---- file names

def name_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1), lambda t: F.lower(t))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def marker_tokens(c: Column, markers: tuple[str, ...] = lexicon.FILE_MARKERS) -> Column:
    """Words of a file's stem once copy, version and draft markers are taken out."""
    text = F.translate(c, "_-", "  ")
    for m in markers:
        text = F.regexp_replace(text, "(?i)" + m, " ")
    return name_tokens(text)


def person_tokens(c: Column, dropped: tuple[str, ...] = (*lexicon.FILE_WORDS, *lexicon.MONTHS)) -> Column:
    """Marker-free words without file words, months, years, counters and time stamps."""
    return F.filter(marker_tokens(c), lambda t: ~t.isin(*dropped) & ~t.rlike(r"^\d+$"))


def is_template(c: Column, words: tuple[str, ...] = lexicon.TEMPLATE_WORDS) -> Column:
    return F.arrays_overlap(name_tokens(c), F.array(*(F.lit(w) for w in words)))


def is_informative(tokens: Column) -> Column:
    """Whether the words can tell a person: two or more, or one of at least seven letters."""
    return (F.size(tokens) >= 2) | ((F.size(tokens) == 1) & (F.length(F.array_join(tokens, "")) >= 7))


# ---- display

def percent_label(c: Column) -> Column:
    """Share as a percentage with one decimal; null and NaN count as nothing."""
    share = F.when(c.isNull() | F.isnan(c.cast("double")), 0.0).otherwise(c.cast("double"))
    return F.format_string("%.1f%%", F.round(share * 100, 1))


def tier(c: Column) -> Column:
    share = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(share >= 0.75, "high").when(share >= 0.5, "mid").otherwise("low")


def size_label(c: Column) -> Column:
    n = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def initials(name: Column, fallback: Column) -> Column:
    """First letters of the first and last word, or the first two letters of a single word."""
    source = strip(F.coalesce(F.nullif(name, F.lit("")), fallback, F.lit("")))
    words = F.split(source, r"\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    out = F.when(F.size(words) == 1, F.substring(first, 1, 2)).otherwise(F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1)))
    return F.when(source == "", "—").otherwise(F.upper(out))


def subtitle(*parts: Column) -> Column:
    return F.concat_ws(" • ", *(F.nullif(p, F.lit("")) for p in parts))
