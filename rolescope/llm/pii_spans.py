"""Candidate spans of personal information and their features (problem 3): plain Python, no Spark.

Generators have high recall and overlap freely; features describe a span's format, its surroundings, and what the rest
of the record says about it. Deciding is left to the trees of ``pii_model``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ..functions.json_tree import parse
from .folding import plain
from .name_linking import CREDENTIALS, TITLES
from .pii_words import FUNCTION_WORDS, WordModel

#: Spans whose shape a worker remembers.
CACHE_SPANS = 200_000
KINDS = ("email", "phone", "id_number", "address", "name")

# Words that announce a kind, and words that announce a code or an amount, in the languages of the corpus.
CUES = {
    "email": "email e-mail mail mailto contact write reach courriel correo",
    "phone": "phone tel telephone telefon téléphone teléfono mobile cell call ring dial text whatsapp ph fax mobil handy",
    "id_number": "passport national id identity identification card social security ssn insurance tax taxpayer personal personnel license licence permit driving ausweis ausweisnummer dni nie nif identité",
    "address": "address addr residence residing resides anschrift adresse wohnhaft dirección domicilio domicile habite lives living live home vive",
    "name": "name applicant candidate referee reference references supervised supervisor guided guide mentor manager chair coach witness signed dear by with dr prof mr mrs ms herr frau",
    "code": "order code norm standard version edition release invoice ticket serial model part lot batch item sku firmware catalogue ref iso",
}
_CUE_OF = {w: k for k, words in enumerate(CUES.values(), 1) for w in words.split()}
# Kinds of streets.
STREETS = "Street St Road Rd Lane Ln Avenue Ave Drive Court Close Square Terrace Crescent Boulevard Blvd Way Place"
STREETS_BEFORE = "rue avenue allée boulevard chemin impasse place quai cours"
STREETS_FIRST = "Calle Avenida Avda Plaza Paseo Camino Via Viale Piazza"
STREET_ENDS = "straße strasse str weg gasse platz allee ufer damm"
# Words of firms, schools, degrees, posts and headings.
INSTITUTION = frozenset(
    "university institute college school academy faculty department technology inc ltd llc gmbh corp company group partners "
    "holdings services solutions systems bank hospital council ministry agency bachelor master diploma degree certificate higher "
    "secondary science arts commerce engineering project programme skills education experience projects references profile summary "
    "contact certifications achievements objective languages senior junior manager engineer officer analyst operator clerk".split()
)

_PIECE = re.compile("[^\\n\\r|  \u0085]*[^\\s|][^\\n\\r|  \u0085]*")
_LOCAL = r"[A-Za-z0-9_+%-]+(?:\.[A-Za-z0-9_+%-]+)*(?:\s?[\[(]dot[\])]\s?[A-Za-z0-9_+%-]+)*"
_EMAIL = re.compile(_LOCAL + r" ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)*", re.I)
_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.I)
_ENDING = re.compile(r"[a-z]+$")
_DIGITS = re.compile(r"(?<!\w)((?:[A-Z]{1,3}[ -]?)?)([+(]?\d(?:(?:[ ./-]|\) ?| ?\()?\d){4,15})((?: ?[A-Z])?)(?![\w])")
_UPPER = "A-ZÀ-ÖØ-Þ"
_STREET_WORD = re.compile(rf"\b(?:{STREETS.replace(' ', '|')}|{STREETS_BEFORE.replace(' ', '|')}|{STREETS_FIRST.replace(' ', '|')})\b|(?:{STREET_ENDS.replace(' ', '|')})\b")
#: Where a kind of street may stand: begins with letters, so that it is searched fast; what stands before is left to the address.
_STREET_AT = re.compile("(?:" + f"{STREETS} {STREETS_BEFORE} {STREETS_FIRST} {STREET_ENDS}".replace(" ", "|") + r")\b")
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|No|Room)\.? ?[0-9]{0,4}[A-Za-z]?"
_ADDRESS = re.compile(
    rf"(?<!\\w)(?=[0-9{_UPPER}])(?:(?:{_UNIT},? )?(?:\d{{1,5}}[A-Za-z]?,? )?(?:[{_UPPER}][\w'’-]+ ){{1,3}}(?:{STREETS.replace(' ', '|')})\b(?:(?<=\bRd)\.|(?<=\bSt)\.|(?<=\bAve)\.|(?<=\bLn)\.|(?<=\bBlvd)\.)?(?:,? (?:Flat|Apt|Apartment|Unit|Suite|No\.?|#) ?\d{{1,4}}[A-Za-z]?\b)?"
    rf"|\d{{1,5}}[a-z]?(?: (?:bis|ter))?,? (?:{STREETS_BEFORE.replace(' ', '|')})(?: (?:de|du|des|la|le|les))* (?:[dl]['’])?[{_UPPER}][\w'’-]+(?: [{_UPPER}][\w-]+)?"
    rf"|(?:{STREETS_FIRST.replace(' ', '|')})\.?(?: (?:de|del|la|los|las|di|dei))* [{_UPPER}][\w'’-]+(?: [{_UPPER}][\w-]+)?,? \d{{1,5}}\w?\b(?:, ?\d{{1,2}} ?[ºª°](?: ?[A-Z]\b)?)?"
    rf"|[{_UPPER}][\w-]*(?:{STREET_ENDS.replace(' ', '|')})\.? \d{{1,5}}[a-z]?\b)"
)
_CAPITAL = rf"(?:(?:Dr|Prof|Mr|Mrs|Ms|Sr|Jr|St)\.|[{_UPPER}][\w'’-]+|[{_UPPER}]\.?(?!\w))"
_RUN = re.compile(rf"(?<![\w@.-]){_CAPITAL}(?:,? +{_CAPITAL})+")
#: One capitalised word behind a form of address; small words behind a form of address or the label of a name.
_TITLED = re.compile(rf"(?<!\w)(?:Dr|Prof|Mr|Mrs|Ms|Miss|Herr|Frau|Mme)\.? +([{_UPPER}][\w'’-]+)(?!\w)")
_LABELLED = re.compile(r"(?i:(?<!\w)(?:(?:dr|prof|mr|mrs|ms)(?:\.|(?=[ \t]))|(?:name|applicant|candidate|referee|reference|supervisor|guide|mentor|manager|contact)s?[ \t]*[:–-]))[ \t]*((?:[^\W\d_A-Z][\w'’-]*\.?,?[ \t]+){1,3}[^\W\d_A-Z][\w'’-]*)")
_SMALL = re.compile(r"(?<!\w)[a-zà-öø-ÿ]{3,}(?!\w)")
#: Letters and digits mixed, as some identity numbers are.
_MIXED = re.compile(r"(?<![\w-])(?=[A-Z0-9-]*[A-Z])(?=(?:[A-Z-]*\d){4})[A-Z0-9]+(?:-[A-Z0-9]+)*(?![\w-])")
_TOKEN = re.compile(r"[^\W\d_][\w'’-]*\.?")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_WORD_BEFORE = re.compile(rf"(?<![\w@.-])([{_UPPER}][\w'’-]*)\.? +$")
_WORD_AFTER = re.compile(rf" +([{_UPPER}][\w'’-]*)")
#: The words that a first line begins with: a form of address, a name of five parts, credentials.
_LEADING = re.compile(r"[^\W\d_][\w'’-]*\.?(?:,? +[^\W\d_][\w'’.-]*){1,7}")
_BRACKET = re.compile(r"[(\[]")
_GROUP = re.compile(r"\d+")
_UNIT_WORD = re.compile(r"\b(?:Flat|Apt|Apartment|Unit|Suite|No|Room)\b|º")
_YEAR = re.compile(r"(?:19|20)\d\d")


@dataclass(frozen=True)
class Record:
    """What is known of the record a text belongs to."""

    name: str = ""
    email: str = ""
    phone: str = ""
    known: tuple[str, ...] = ()  # values of members that hold no person: posts, firms, schools, degrees, skills, project names


def free_texts(document) -> list[tuple[str, str]]:
    """(path, text) of the free text of a profile document: raw_text, the values of sections, and raw_text and
    description of experience and projects. Members of other shapes hold no free text."""
    if not isinstance(document, dict):
        return []
    out = []
    if type(document.get("raw_text")) is str:
        out.append(("raw_text", document["raw_text"]))
    sections = document.get("sections")
    if isinstance(sections, dict):
        for label, value in sections.items():
            for k, text in enumerate(value if isinstance(value, list) else [value]):
                if type(text) is str:
                    out.append((f"sections.{label}" + (f"[{k}]" if isinstance(value, list) else ""), text))
    for member in ("experience", "projects"):
        entries = document.get(member)
        for k, entry in enumerate(entries if isinstance(entries, list) else [entries]):
            if isinstance(entry, dict):
                out += [(f"{member}[{k}].{f}", entry[f]) for f in ("raw_text", "description") if type(entry.get(f)) is str]
    return out


def known_values(document) -> tuple[str, ...]:
    """Values of posts, firms, schools, degrees, skills, project and certificate names of a profile document."""
    if not isinstance(document, dict):
        return ()
    out = []
    for member, fields in (("experience", ("title", "organization")), ("education", ("degree", "institution")), ("projects", ("name",))):
        entries = document.get(member)
        for entry in entries if isinstance(entries, list) else [entries]:
            if isinstance(entry, dict):
                out += [entry[f] for f in fields if type(entry.get(f)) is str]
    for member in ("certifications", "skills"):
        entries = document.get(member)
        out += [c for c in (entries if isinstance(entries, list) else [entries]) if type(c) is str]
    return tuple(out)


def document_of(text: str | None):
    """Parsed profile document; None for null and malformed ones."""
    if text is None:
        return None
    try:
        return parse(text)
    except ValueError:
        return None


def pieces_of(texts: list[str]) -> list[str]:
    """Distinct pieces of the texts, in order: what stands between line ends and bars."""
    seen: dict[str, None] = {}
    for text in texts:
        for m in _PIECE.finditer(text):
            seen.setdefault(m.group().strip())
    return list(seen)


@lru_cache(maxsize=50_000)
def _bare_names(run: str, parts: bool = True) -> list[tuple[int, int]]:
    """Spans within a run of words that may be a name: every stretch of two to five words without titles and closing
    credentials inside a comma's bounds, and one or two words on both sides of a comma. Without ``parts``, for a text that
    is a name or none as a whole, only the whole and all but its first word."""
    tokens = [(m.start(), m.end(), m.group().rstrip(".").lower()) for m in _TOKEN.finditer(run)]
    while len(tokens) > 1 and tokens[-1][2] in CREDENTIALS:
        tokens.pop()
    groups: list[list[tuple[int, int]]] = [[]]
    commas = set()  # groups that a comma parts from the one before
    end = 0
    for start, stop, word in tokens:
        if "," in run[end:start]:
            groups.append([])
            commas.add(len(groups) - 1)
        if word in TITLES:
            if groups[-1]:
                groups.append([])
        else:
            groups[-1].append((start, stop))
        end = stop
    out = []
    for k, g in enumerate(groups):
        out += [(g[i][0], g[j][1]) for i in range(len(g)) for j in range(i + 1, min(i + 5, len(g))) if parts or j == len(g) - 1 and i <= 1]
        if k in commas:
            out += [(x[0], y[1]) for x in groups[k - 1][-2:] for y in g[:2]]
    return [(a, b) for a, b in out if not _GROUP.search(run, a, b)] if _GROUP.search(run) else out


#: Characters that an e-mail address has before and behind its at sign: 64 and 255 by its standard, and as many again for dots
#: and blanks that are written out.
BEFORE_AT, BEHIND_AT = 128, 510


def _piece_bounds(joined: str, starts: list[int], pattern: re.Pattern):
    """Bounds of the pieces that hold a match, each once."""
    last = -1
    for m in pattern.finditer(joined):
        k = bisect_right(starts, m.start()) - 1
        if k != last:
            last = k
            yield starts[k], starts[k + 1] - 1 if k + 1 < len(starts) else len(joined)


def _bare_values(record: Record) -> set[str]:
    return {b for b in (_BRACKET.split(record.name)[0][a:e].strip() for a, e in _bare_names(_BRACKET.split(record.name)[0], False)) if len(b) >= 4}


def _occurrences(text: str, value: str):
    at = text.find(value)
    while at >= 0:
        yield at, at + len(value)
        at = text.find(value, at + len(value))


def candidates(joined: str, starts: list[int], record: Record) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that may be personal information, in pieces joined by line ends: every occurrence, in
    texts of any length. A name has two to five parts, or one behind a form of address."""
    out, runs = proposed(joined, starts, record)
    out.update((4, base + a, base + b) for base, run in runs for a, b in _bare_names(run))
    return sorted(out)


def proposed(joined: str, starts: list[int], record: Record) -> tuple[set[tuple[int, int, int]], list[tuple[int, str]]]:
    """``candidates`` without the names inside runs of capitalised words, and these runs with their places: what may be a name inside
    a run depends on the run alone and is found once for all records that repeat it."""
    out = set()
    for m in _AT.finditer(joined):
        k = bisect_right(starts, m.start()) - 1
        end = starts[k + 1] - 1 if k + 1 < len(starts) else len(joined)
        out.update((0, e.start(), e.end()) for e in _EMAIL.finditer(joined, max(starts[k], m.start() - BEFORE_AT), min(end, m.end() + BEHIND_AT)))
    for m in _DIGITS.finditer(joined):
        start, end = m.span(2)
        if "\n" not in m.group():
            out.add((1, start, end))
            out.add((2, m.start(), m.end()))
            if m.group(1) or m.group(3):
                out.add((2, start, end))
    out.update((2, m.start(), m.end()) for m in _MIXED.finditer(joined))
    for low, high in _piece_bounds(joined, starts, _STREET_AT):
        out.update((3, e.start(), e.end()) for e in _ADDRESS.finditer(joined, low, high))
    runs = [(m.start(), m.group()) for m in _RUN.finditer(joined)]
    out.update((4, m.start(1), m.end(1)) for m in _TITLED.finditer(joined))
    for m in _LABELLED.finditer(joined):
        base = m.start(1)
        out.update((4, base + a, base + b) for a, b in _bare_names(m.group(1)))
    # A name in small letters: what a first line begins with, or what the record calls the person, wherever it stands.
    first = joined[: starts[1] - 1] if len(starts) > 1 else joined
    lead = _LEADING.match(first)
    if lead:
        out.update((4, a, b) for a, b in _bare_names(lead.group(), lead.end() < len(first) and first[lead.end()] not in "([-|"))
    small = joined.lower()
    if len(small) == len(joined):
        for bare in _bare_values(record):
            out.update((4, a, b) for a, b in _occurrences(small, bare.lower()) if not (joined[a - 1 : a].isalnum() or joined[b : b + 1].isalnum()))
    else:  # a letter that is longer in small
        for bare in _bare_values(record):
            out.update((4, m.start(), m.end()) for m in re.finditer(rf"(?<!\w){re.escape(bare)}(?!\w)", joined, re.I))
    for kind, value in ((0, record.email), (1, record.phone)):
        if len(value) >= 5:
            out.update((kind, a, b) for a, b in _occurrences(joined, value))
    return out, runs


_COMMON = "own_cue other_cue code_cue after_mark first_line line_start line_end is_column before_kind"
#: Features of each kind, in the order in which ``features`` gives them.
FEATURES = tuple(
    f"{_COMMON} {own}".split()
    for own in (
        "length at_sign dots spaces domain_dots ending",
        "digits groups first_group last_group plus brackets dots hyphens spaces years letters_beside",
        "digits groups first_group last_group dots hyphens spaces prefix suffix years is_phone letters",
        "length words street_last number_first digits unit comma in_known",
        "length words capitals upper lower comma initials look_first look_last look_least look_mean institution function_words "
        "column_share in_known small_elsewhere run_before run_after look_before look_after title_before",
    )
)
#: Features of a name that depend on its words alone.
NAME_SHAPE = 13
_AROUND = ".,:;-<>()[]\"'"
_MARKS = {c: k for k, c in enumerate("\n ,.;:)>(", 1)}


@dataclass
class Context:
    """What the features of a record's spans have in common, and what was found of places where several spans begin or end."""

    joined: str
    record: Record
    known: frozenset[str]
    known_text: str
    column_words: frozenset[str]
    small: frozenset[str]  # words that the record writes in small letters
    begins: dict[int, tuple] = field(default_factory=dict)
    finishes: dict[int, tuple] = field(default_factory=dict)


def context_of(joined: str, record: Record) -> Context:
    small = frozenset(_SMALL.findall(joined))
    column = frozenset(plain(w) for w in _WORD.findall(record.name))
    return Context(joined, record, frozenset(record.known), "\n".join(record.known), column, small)


def _before_kind(joined: str, low: int, start: int) -> float:
    """0 at the start of a piece, else what stands before the blank: 1 a small word, 2 a capitalised one, 3 the end of a sentence,
    4 another mark, 5 a digit."""
    at = start - 1
    while at >= low and joined[at] == " ":
        at -= 1
    if at < low:
        return 0.0
    c = joined[at]
    if c.isalpha():
        word = at
        while word > low and (joined[word - 1].isalpha() or joined[word - 1] in "'’-"):
            word -= 1
        return 2.0 if joined[word].isupper() else 1.0
    return 3.0 if c in ".!?" else 5.0 if c.isdigit() else 4.0


def _cues(before: str) -> list[int]:
    """Kinds announced by the three words before a span, as far as they belong to its sentence."""
    out = []
    for word in reversed(before.lower().replace("/", " ").split()[-3:]):
        bare = word.strip(_AROUND)
        if bare in _CUE_OF:
            out.append(_CUE_OF[bare])
        elif word[-1] in ".!?" and len(bare) > 2:
            break
    return out


def _beginning(own: Context, low: int, start: int, look) -> tuple:
    """Cues before a place, what stands before it, and of a capitalised word before it: whether there is one that is no form of
    address, how much it looks like a name, whether it is a form of address."""
    joined = own.joined
    if start == low:
        return (), 0.0, 0.0, 0.0, 0.0
    m = _WORD_BEFORE.search(joined, max(low, start - 30), start) if joined[start - 1] == " " else None
    word = m.group(1) if m else ""
    titled = word.lower() in TITLES
    named = word != "" and not titled
    return _cues(joined[max(low, start - 40) : start]), _before_kind(joined, low, start), float(named), look(word) if named else 0.0, float(titled)


def _end_of(own: Context, end: int, high: int, look) -> tuple:
    """Mark behind a place, and of a capitalised word behind it: whether there is one, and how much it looks like a name."""
    if end >= high:
        return 1, 0.0, 0.0
    joined = own.joined
    m = _WORD_AFTER.match(joined, end, high) if joined[end] == " " else None
    return _MARKS.get(joined[end], 0), float(m is not None), look(m.group(1)) if m else 0.0


@lru_cache(maxsize=4096)
def _number_shape(span: str) -> tuple[tuple, tuple, float]:
    """Digits and groups of digits of a span, its marks, and whether all groups are years."""
    groups = _GROUP.findall(span)
    sizes = (sum(map(len, groups)), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0)
    return sizes, (span.count("."), span.count("-"), span.count(" ")), float(bool(groups) and all(_YEAR.fullmatch(g) for g in groups))


def features(kind: int, start: int, end: int, own: Context, low: int, high: int, shape_of, look) -> list[float]:
    """Feature values of one span; ``low`` and ``high`` bound its piece, ``shape_of`` gives the ``name_shape`` of a text."""
    joined, record = own.joined, own.record
    span = joined[start:end]
    begin = own.begins.get(start)
    if begin is None:
        begin = own.begins[start] = _beginning(own, low, start, look)
    finish = own.finishes.get(end)
    if finish is None:
        finish = own.finishes[end] = _end_of(own, end, high, look)
    own_cue = other = code = 0.0
    for c in begin[0]:
        if c == kind + 1:
            own_cue = 1.0
        elif c == 6:
            code = 1.0
        else:
            other = 1.0
    value = (record.email, record.phone, "", "", record.name)[kind]
    is_column = 1.0 if value and (span == value or kind == 4 and end - start > 4 and span in value) else 0.0
    row = [own_cue, other, code, finish[0], 1.0 if low == 0 else 0.0, 1.0 if start == low else 0.0, 1.0 if end == high else 0.0, is_column, begin[1]]
    if kind == 4:
        shape, folded, words, _ = shape_of(span)
        column = own.column_words
        share = sum([w in column for w in folded]) / len(folded) if column and folded else 0.0
        known = 0.0 if span not in own.known_text else 2.0 if span in own.known else 1.0
        small = own.small
        row += shape
        row += (share, known, sum([w in small for w in words]) / len(words) if words else 0.0, begin[2], finish[1], begin[3], finish[2], begin[4])
        return row
    if kind == 0:
        low_span = span.lower()
        domain = _AT.split(low_span, maxsplit=1)[-1]
        ending = _ENDING.search(domain)
        return [*row, end - start, float("@" in span), low_span.count(".") + low_span.count("dot"), span.count(" "), domain.count(".") + domain.count("dot"), len(ending.group()) if ending else 0]
    if kind < 3:
        sizes, marks, years = _number_shape(span)
        if kind == 1:
            beside = joined[max(low, start - 3) : start]
            return [*row, *sizes, float(span[0] == "+" or span[:2] == "00"), float("(" in span), *marks, years, float(beside[-1:] in "- " and beside[:2].isupper())]
        return [*row, *sizes, *marks, float(span[0].isalpha()), float(span[-1].isalpha()), years, float(span in record.phone), sum(map(str.isalpha, span))]
    words = _WORD.findall(span)
    n = len(words) or 1
    known = 0.0 if span not in own.known_text else 2.0 if span in own.known else 1.0
    return row + [end - start, n, float(bool(words) and bool(_STREET_WORD.fullmatch(words[-1]))), float(span[0].isdigit()), float(_GROUP.search(span) is not None), float(_UNIT_WORD.search(span) is not None), float("," in span), known]


@lru_cache(maxsize=CACHE_SPANS)
def _word_facts(word: str) -> tuple[str, str, float, float, float, float]:
    """Folded and small form of a word; whether it is capitalised, an initial, a word of firms and posts, a function word."""
    folded = plain(word)
    return folded, word.lower(), float(word[0].isupper()), float(len(folded) < 2), float(folded in INSTITUTION), float(folded in FUNCTION_WORDS)


def name_shape(span: str, look) -> tuple[list[float], list[str], list[str]]:
    """Features of a name candidate that depend on its words alone, the folded words, and the words in small letters."""
    words = _WORD.findall(span)
    capitals = initials = institution = function = 0.0
    folded, small, looks = [], [], []
    for w in words:
        f, low, capital, initial, inst, func = _word_facts(w)
        folded.append(f)
        small.append(low)
        capitals += capital
        initials += initial
        institution += inst
        function += func
        if not initial:
            looks.append(look(w))
    lower = span.islower()
    return [
        len(span), len(words) or 1, capitals, float(span.isupper()), float(lower), float("," in span), initials,
        looks[0] if looks else 0.0, looks[-1] if looks else 0.0, min(looks) if looks else 0.0, sum(looks) / (len(looks) or 1), 1.0 if institution else 0.0, function,
    ], folded, [] if lower else small


@dataclass
class Batch:
    """Candidates of some records, ready for the trees."""

    spans: list[tuple[int, int, int, int]]  # record, kind, start, end
    rows: list[list[float]]
    joined: list[str]


@dataclass
class Seen:
    """What a worker remembers: the shape of a span of words and whether it may be a name, and the names that a run may hold."""

    shapes: dict[str, tuple] = field(default_factory=dict)
    runs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)


def describe(items: list[tuple[list[str], Record]], words: WordModel, seen: Seen | None = None, keeps=None) -> Batch:
    """Candidates and features of (texts, record) pairs; pieces that a record repeats are described once.

    ``keeps`` is the first stage of a cascade: of an array of ``name_shape`` rows it tells which may be names at all. Others are
    not described any further, unless the record's own name holds them.
    """
    batch = Batch([], [], [])
    seen = Seen() if seen is None else seen
    shapes, runs = seen.shapes, seen.runs
    if len(shapes) + len(runs) >= CACHE_SPANS:
        shapes.clear()
        runs.clear()
    look = words.look
    waiting = []
    fresh: dict[str, tuple] = {}
    new_runs: dict[str, list[tuple[int, int]]] = {}

    def ask(span: str) -> None:
        if span not in shapes and span not in fresh:
            fresh[span] = name_shape(span, look)

    for texts, record in items:
        pieces = pieces_of(texts)
        joined = "\n".join(pieces)
        batch.joined.append(joined)
        starts, at = [], 0
        for p in pieces:
            starts.append(at)
            at += len(p) + 1
        spans, own_runs = proposed(joined, starts, record)
        waiting.append((starts, spans, own_runs))
        for kind, start, end in spans:
            if kind == 4:
                ask(joined[start:end])
        for _, run in own_runs:
            if run not in runs and run not in new_runs:
                new_runs[run] = _bare_names(run)
                for a, b in new_runs[run]:
                    ask(run[a:b])
    good = keeps(np.array([f[0] for f in fresh.values()])).tolist() if keeps and fresh else [True] * len(fresh)
    for (span, found), kept in zip(fresh.items(), good, strict=True):
        shapes[span] = (*found, kept)
    for run, names in new_runs.items():
        runs[run] = [(a, b) for a, b in names if shapes[run[a:b]][3]]

    for r, ((_, record), (starts, spans, own_runs)) in enumerate(zip(items, waiting, strict=True)):
        joined = batch.joined[r]
        own = context_of(joined, record)
        last = len(starts) - 1
        for base, run in own_runs:
            for a, b in runs[run]:
                spans.add((4, base + a, base + b))
        for kind, start, end in sorted(spans):
            if kind == 4:
                span = joined[start:end]
                if not shapes[span][3] and span not in record.name:
                    continue
            k = bisect_right(starts, start) - 1
            low, high = starts[k], (starts[k + 1] - 1 if k < last else len(joined))
            if end <= high:
                batch.spans.append((r, kind, start, end))
                batch.rows.append(features(kind, start, end, own, low, high, shapes.__getitem__, look))
    return batch


def redacted(text: str, by_piece: dict[str, list[tuple[int, int, str]]]) -> str:
    """Text with the spans of its pieces replaced by typed placeholders such as [EMAIL]."""

    def replace(m: re.Match) -> str:
        whole = m.group()
        piece = whole.strip()
        spans = by_piece.get(piece)
        if not spans:
            return whole
        lead = len(whole) - len(whole.lstrip())
        out, at = [whole[:lead]], 0
        for start, end, kind in sorted(spans):
            out += [piece[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join([*out, piece[at:], whole[lead + len(piece) :]])

    return _PIECE.sub(replace, text)

