"""The boosted trees that decide which candidate spans are personal information (problem 3), and what they learn from.

Two bounded samples are labelled without a human: invented notes and letters, whose spans are known because they were put
there, and sampled rows, whose columns and members say what some spans are. The sentences of the invented texts are of other
matters than the profiles and share no wording with them. Fitting takes seconds on the driver; corpus rows are only scored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect
from dataclasses import dataclass, field

import numpy as np

from .boosting import BoostedTrees, Calibrated, fit_calibrated, fit_trees
from .folding import plain
from .name_linking import CREDENTIALS, TITLES
from .pii_spans import CUES, FEATURES, KINDS, NAME_SHAPE, Batch, Record, Seen, describe
from .pii_words import FUNCTION_WORDS, WordModel, fit_words

#: Invented documents, rows of the table, and names of the table that are fitted on.
INVENTED_DOCUMENTS, SAMPLED_ROWS, SAMPLED_NAMES = 900, 400, 4_000
#: Rounds of boosting; stretches of one run of words differ by little, so names take more.
ROUNDS, NAME_ROUNDS = 40, 80
#: Rounds of the gate, and log-odds by which it keeps what scores below the least true span.
GATE_ROUNDS, GATE_SLACK = 20, 0.5

# Sentences that hold one value of a kind, by kind; {v} is the value, {t} a town.
SENTENCES = {
    "email": "Questions about the minutes go to {v} before Friday.|Our treasurer answers under {v}.|Copies were forwarded to {v} and filed.|Bitte Rückfragen an {v} senden.|Une copie part vers {v} chaque lundi.|"
    "Escriba a {v} si falta algo.|The club secretary is reached via {v}.|Send the signed form back to {v} or hand it in.|Seed lists: {v}",
    "phone": "The caretaker picks up at {v} on weekdays.|If the gate is locked ring {v} and wait.|New number since spring: {v}|Text {v} on arrival.|Unter {v} ist das Büro erreichbar.|Joignable au {v} le soir.|"
    "Llame al {v} por la tarde.|In emergencies dial {v}, otherwise leave a note.|The boathouse answers on {v}",
    "id_number": "The clerk copied passport no. {v} into the register.|The licence number reads {v} since the renewal.|Insurance number {v} was confirmed by the office.|Please quote the national identity number {v} on the form.|"
    "Seine Ausweisnummer lautet {v}.|Con DNI {v} firmó el contrato.|Driving permit {v} expires next year.|The taxpayer number {v} belongs to the tenant.|The file mentions social insurance no {v}.|carte d'identité {v}",
    "address": "The parcel went to {v} by mistake.|We moved from {v} last autumn.|Deliveries are accepted at {v} until noon.|Keys are kept at {v}, {t}.|Wohnhaft in {v}, {t}.|Habite au {v} depuis mars.|Vive en {v} desde enero.|"
    "Registered office of the tenant: {v}|The piano stands in {v}, {t}, second door.",
    "name": "My neighbour {v} lent us a ladder.|The minutes were taken by {v} and approved.|We owe thanks to {v}, who repaired the boiler.|In the evening {v} played the organ.|Together with {v} we catalogued the herbarium.|"
    "Mit {v} haben wir den Garten angelegt.|Avec {v}, nous avons repeint la salle.|Junto a {v} ordenamos la biblioteca.|According to {v}, the bridge stays closed.|Coach {v} moved the match to Sunday.|A letter from {v} arrived.|"
    "{v} chaired the assembly.|{v} wrote the chapter on moths.|Present: {v} and the two tenants.|Chair: {v}|Witness - {v}|Signed, {v}|Photograph: {v} (archive)|Dear {v}, the seeds have arrived.|It was Dr. {v} who found the error.|"
    "Ask Prof. {v} about the fossils.|The jury praised Ms. {v} twice.|Mentor: Dr. {v}|Witness: {v} (since spring)|{v} keeps the keys.|Lent by {v}.|Guide for the walk - Mr. {v}|The harvest was weighed by {v}|{v}, choir|"
    "Dr. {v} {post}|Witness {v}|{v} {post}|Coach {v} {post}|Former {post} {v} {house}",
}
# Sentences without any such value. {n}, {m} are numbers, {y}, {z} years, {code} a code, {ver} a version, {item} small things, {big} an
# amount, {digits} a plain number, {house} and {post} a capitalised name of a thing and of an occupation.
DECOYS = (
    "The ferry of {y} carried {n} passengers.|Ticket {code} was closed after {n} days.|Printed on {n} gsm paper, edition {ver}.|A budget of {big} euro was approved in {y}.|Open {n}-{m}, closed from {y} to {z}.|Standard {code} replaced the one of {y}.|"
    "Bought {n} {item} @ {m} cents each.|The hall on Market Street was repainted.|Lot {code} of the auction stayed unsold.|Firmware {ver} fixes the clock.|Catalogue number {digits} is out of print.|Between {y} and {z} the mill stood empty.|"
    "Room {n} seats {m} people.|Model {code} draws {n} watts.|{house} opens in spring.|The {house} and the {house} share a roof.|A {post} is wanted for the summer.|Every {post} gets a key.|Invoice {code}, {big} paid.|"
    "Part {digits} fits the pump of {y}-{z}.|The choir sang in {house}.|A path leads along the old Station Road to the weir.|Batch {code} and item {code} were swapped.|Walk: {n} km, {m} stiles.|Order {code} left the yard on Monday.|"
    "ISO {m}{n} and norm {code} apply.|Rain fell on {n}.{m}.{y} and {y}-0{d}-1{d}.|Version {ver} of the song book|{house}, {y}-{z}|{post}, {house} {y} - {z}|Serial {digits}, built {y}|{n} {item} @ {m} each, release {ver}|{item} @ {big} per crate|Weighed {item} @ {n} grams and {m} {item} @ {n}.{m} euro|Meet @ noon behind the {house}|Gauge {ver} @ {n}.{m} bar"
)
# Parts of the names of things and of occupations.
_HOUSES = ("Northern Central Royal Open Marine Rural Alpine Civic Riverside Golden Silver Modern United".split(), "Railway Flower Harvest Harbour Paper Glass Winter Science Folk Steam Timber Chess".split(), "Museum Festival Library Bridge Theatre Orchestra Gardens Fisheries Observatory Union Works Society Group Project".split())
_POSTS = ("Choir School Stage Museum Harbour Senior Tree Ferry Chief Night Data Garden Store Quality Sales".split(), "Director Librarian Manager Guide Pilot Surgeon Captain Porter Analyst Engineer Designer Keeper Inspector Assistant Buyer".split())
# Frequent given and family names of several languages.
GIVEN_NAMES = (
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty mark margaret paul sandra "
    "peter anna hans ursula klaus monika jürgen petra stefan sabine jonas lena pierre marie jean nathalie michel isabelle luc claire josé carmen juan maria antonio ana carlos lucía giulia marco wei li mei hiroshi yuki "
    "ahmed fatima omar aisha ivan olga dmitri elena raj priya amit sunita arjun lakshmi kwame ama chidi ngozi lars ingrid erik astrid tomasz katarzyna piotr zofia"
).split()
FAMILY_NAMES = (
    "smith johnson williams brown jones garcia miller davis wilson anderson taylor moore jackson martin lee thompson white harris clark lewis walker young king wright scott hill green adams baker nelson "
    "müller schmidt schneider fischer weber meyer wagner becker hoffmann schulz koch bauer richter klein wolf neumann schwarz zimmermann krüger keller bernard dubois durand leroy moreau laurent lefebvre "
    "rodriguez martinez hernandez lopez gonzalez perez sanchez rossi ferrari bianchi wang zhang chen liu nguyen tran kim park tanaka suzuki singh patel sharma kumar gupta khan ali hassan ivanov petrov novak kowalski "
    "hansen olsen larsson nilsson okafor mensah silva santos costa"
).split()
_SYLLABLES = "bar cal dor el fen gar hol ir jas kel lor mar nev or pel quin ros sal tor ul ver wen yor zan ha mo ri ta ko li na su".split()
_ENDS = "ton field man ley worth stein berg ova sen dez ini eau moor wick by mann er ski ez o a i en is".split()
_TITLE_FORMS = ("", "", "", "", "Dr. ", "Prof. ", "Mr ", "Ms. ")
_AFTER_NAME = ("", "", "", "", ", PMP", ", CPA", " (M.Sc.)", ", PhD")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def name_words(names: list[str]) -> list[list[str]]:
    """Folded words of each typed name, without titles and credentials."""
    out = []
    for name in names:
        words = [plain(w) for w in _NAME_WORD.findall(re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name))]
        words = [w for w in words if w not in TITLES and w not in CREDENTIALS]
        if words:
            out.append(words)
    return out


_SMALL = re.compile(r"(?<![\w.+-])[a-zà-öø-ÿß]{2,}(?![\w@])")
_MAILBOX = re.compile(r"\S+ ?(?:@|[\[(] ?at ?[\])]) ?\S+", re.I)


def common_words(texts: list[str], record: Record) -> set[str]:
    """Words that a record shows to be no names: written small in its texts, or parts of its posts, firms, schools and skills; not
    those of its own name."""
    own = {plain(w) for w in _NAME_WORD.findall(record.name)}
    out = {plain(w) for t in texts for w in _SMALL.findall(_MAILBOX.sub(" ", t))} | {plain(w) for v in record.known for w in _NAME_WORD.findall(v)}
    return out - own


@dataclass
class Invented:
    """Random but repeatable values and texts."""

    rng: random.Random
    given: list[str]
    family: list[str]

    def word(self) -> str:
        r = self.rng
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 2))).capitalize() + r.choice(_ENDS)

    def name(self) -> str:
        r = self.rng
        form, own = r.random(), r.random()
        given = r.choice(self.given).capitalize() if self.given and own < 0.6 else r.choice(GIVEN_NAMES).capitalize() if own < 0.9 else self.word()
        family = r.choice(self.family).capitalize() if self.family and form < 0.45 else r.choice(FAMILY_NAMES).capitalize() if form < 0.75 else self.word()
        if r.random() < 0.05:
            family = family[:3] + r.choice("- ") + family[3:].capitalize()
        form = r.random()
        if form < 0.5:
            out = f"{given} {family}"
        elif form < 0.6:
            out = f"{family}, {given}"
        elif form < 0.7:
            out = f"{family} {given}"
        elif form < 0.78:
            out = f"{given} {r.choice('ABCDEFGHKLMNPRSTW')}. {family}"
        elif form < 0.86:
            out = f"{given} {r.choice(self.given).capitalize() if self.given else self.word()} {family}"
        else:
            out = r.choice((f"{given[0]}. {family}", f"{family} {given[0]}.", f"{given[0]} {family}"))
        if r.random() < 0.04:
            out = out.replace(" ", "  ")
        return out.upper() if r.random() < 0.12 else out.lower() if r.random() < 0.14 else out

    def full_name(self) -> str:
        while True:
            n = self.name()
            if "," not in n and "." not in n and n[:1].isupper() and not n.isupper() and min(map(len, n.split())) > 2:
                return n

    def digits(self, pattern: str) -> str:
        r = self.rng
        return "".join(str(r.randint(0, 9)) if c == "9" else r.choice("ABCDEFGHJKLMNPQRSTXZV") if c == "A" else c for c in pattern)

    def phone(self) -> str:
        # Usual ways to write telephone numbers.
        forms = "9999999999|(999) 999-9999|999.999.9999|999-999-9999|+1-999-999-9999|+1 999 999 9999|07999 999999|01999 999 999|020 9999 9999|+44 20 9999 9999|+44 7999 999999|+49 (0)30 99999 999|0049 30 99999999|030 9999999|+33 6 99 99 99 99|01 99 99 99 99|+34 699 999 999|+91-99999 99999"
        return self.digits(self.rng.choice(forms.split("|")))

    def identity(self) -> str:
        # Shapes of identity, passport, tax and insurance numbers of several countries.
        forms = "999-99-9999|999.999.999-99|9999 9999 9999|AA999999A|AA 99 99 99 A|AA9999999|99999999A|A9999999|9999-9999-9999|999 99 9999|999 999 999|A9999-99999-99999|AAAAAA99A99A999A|99 999 999 999|A9A99A999|AA-9999-9999-9"
        return self.digits(self.rng.choice(forms.split("|")))

    def code(self) -> str:
        r = self.rng
        head = self.digits("A" * r.randint(1, 4))
        return head + r.choice("- ") * (r.random() < 0.85) + r.choice("-/-").join(self.digits("9" * r.randint(1, 6)) for _ in range(r.randint(1, 3)))

    def email(self) -> str:
        r = self.rng
        local = r.choice(("{a}.{b}", "{a}{n}", "{b}_{a}", "{b}.{a}+list", "{c}{b}", "{a}-{b}")).format(a=self.word().lower(), b=self.word().lower(), c=r.choice("abcd"), n=r.randint(1, 99))
        domain = ".".join((self.word().lower(), *([self.word().lower()] if r.random() < 0.3 else []), r.choice("org com net example test de fr es co.uk".split())))
        form = r.random()
        if form < 0.7:
            out = f"{local}@{domain}"
        elif form < 0.8:
            out = f"{local} (at) {domain}"
        elif form < 0.9:
            out = f"{local.replace('.', ' [dot] ')} [at] {domain.replace('.', ' [dot] ')}"
        else:
            out = f"{local} @ {domain}"
        return out.upper() if r.random() < 0.08 and form < 0.7 else out

    def address(self) -> str:
        r = self.rng
        n, w = r.randint(1, 240), self.word()
        street = r.choice("Street Lane Road Avenue Drive Court Square Close".split())
        return r.choice((
            f"{n} {w} {street}", f"{n} {w} {street}", f"{n} {w} Rd.", f"{n} {w} St.", f"Flat {r.randint(1, 9)}, {n} {w} {street}", f"{n} {w} {street}, Apt {r.randint(1, 20)}{r.choice('ABC')}",
            f"No. {n} {w} {street}", f"{w}straße {n}", f"{w}weg {n}{r.choice(('', 'a', 'b'))}", f"{n}, rue {w}", f"{n} bis, allée des {w}s", f"Calle {w} {n}, {r.randint(1, 9)}º B", f"Avenida {w} {n}",
        ))

    def value(self, kind: str) -> str:
        return {"email": self.email, "phone": self.phone, "id_number": self.identity, "address": self.address, "name": self.full_name}[kind]()

    def thing(self) -> str:
        r = self.rng
        parts = r.choice((_HOUSES, _HOUSES, _HOUSES[1:]))
        own = " ".join(r.choice(p) for p in parts)
        return f"{self.word()} {own}" if r.random() < 0.4 else own

    def post(self) -> str:
        return " ".join(self.rng.choice(p) for p in _POSTS)

    def contact(self, kind: str) -> tuple[str, str]:
        """(piece, span) of a line that holds a value of a kind: bare, behind a word that announces it, or in a sentence."""
        r = self.rng
        v = self.value(kind)
        if kind != "name" and r.random() < 0.6:
            label = r.choice(CUES[kind].split())
            label = label.capitalize() if r.random() < 0.7 else label
            bare = r.random() < 0.4 and kind != "id_number"
            piece = v if bare else label + r.choice((": ", " ", ": ", " - ", ":", " number ", " <")) + v
            piece += ">" if " <" in piece else ""
        else:
            piece = r.choice(SENTENCES[kind].split("|")).format(v=v, t=self.word(), post=self.post(), house=self.thing())
        if kind == "address" and r.random() < 0.3:
            piece = piece.replace(v, f"{v}, {self.word()}") if piece.endswith(v) else piece
        return piece, v

    def decoy(self) -> str:
        r = self.rng
        y = r.randint(1950, 2024)
        return r.choice(DECOYS.split("|")).format(
            n=r.randint(2, 700), m=r.randint(2, 99), y=y, z=y + r.randint(1, 9), d=r.randint(1, 9), code=self.code(), ver=".".join(str(r.randint(0, 40)) for _ in range(r.randint(2, 4))),
            big=f"{r.randint(1, 999)},{r.randint(0, 999):03d}" + ",000" * (r.random() < 0.5), digits=self.digits("9" * r.randint(5, 10)), house=self.thing(), post=self.post(),
            item=r.choice("bulbs stamps tiles crates planks radiators envelopes jars thermometers of pcs cobblestones reels".split()),
        )

    def phrase(self) -> str:
        """A capitalised or small item of a list, no name."""
        out = self.rng.choice((self.thing, self.post, lambda: " ".join(self.rng.choice(p) for p in (_HOUSES[1], _POSTS[1]))))()
        form = self.rng.random()
        return out.lower() if form < 0.3 else out.capitalize() if form < 0.5 else out.upper() if form < 0.55 else out

    def document(self) -> tuple[list[str], Record, set[tuple[int, str]]]:
        r = self.rng
        lines, truth, known = [], set(), []
        name = self.name()
        column = r.choice(_TITLE_FORMS) + name + r.choice(_AFTER_NAME)
        if r.random() < 0.75:
            lines.append(column)
            truth.add((4, name))
        else:
            lines.append(r.choice((f"Notice {r.randint(1, 99)}", self.thing(), f"Sheet {r.randint(1, 99)} of {r.randint(100, 200)}", self.decoy(), self.decoy().lower(), self.phrase())))
        email = phone = ""
        if r.random() < 0.1:
            lines.clear()
            truth.clear()
        for _ in range(r.randint(0, 4)):
            kind = r.randrange(4)
            piece, span = self.contact(KINDS[kind])
            lines.append(piece)
            piece = piece if piece.startswith(span) or r.random() < 0.7 else piece[0].lower() + piece[1:]
            truth.add((kind, span))
            email = span if kind == 0 and r.random() < 0.7 else email
            phone = span if kind == 1 and r.random() < 0.7 else phone
        if r.random() < 0.4 and len(lines) > 2:
            lines[1:] = [" | ".join(lines[1:])]
        lines += ["", r.choice(("LISTS", "Lists:", "Notes")), ", ".join(self.phrase() for _ in range(r.randint(2, 8)))]
        for _ in range(r.randint(1, 4)):
            title, firm = self.post(), f"{self.word()} {r.choice(_HOUSES[1])} {r.choice(_HOUSES[2])}"
            owner = self.full_name() if r.random() < 0.1 else ""
            firm = f"{owner} {r.choice(_HOUSES[2])}" if owner else firm
            lines.append(r.choice((f"{title}, {firm} {r.choice(('2007-2010', '2012 – 2015', 'Jan 2014 to Dec 2016', ''))}", f"{firm} - {title}", title, firm)))
            known += [title, firm] if r.random() < 0.6 else []
            body = [self.decoy() for _ in range(r.randint(1, 3))]
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                kind = r.choice((0, 1, 2, 3, 4, 4, 4))
                piece, span = self.contact(KINDS[kind])
                truth.add((kind, span))
                body.insert(r.randint(0, len(body)), piece if piece[-1] in ".>" else piece + ".")
            if owner and r.random() < 0.7:
                truth.add((4, owner))
                body.append(r.choice(SENTENCES["name"].split("|")[:16]).format(v=owner))
            if r.random() < 0.15:
                truth.add((4, name))
                body.append(f"Noted by {name.lower() if r.random() < 0.5 else name}.")
                truth.add((4, name.lower()))
            lines.append(" ".join(body))
        lines += [self.phrase() for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            piece, span = self.contact("name")
            lines.append(piece)
            truth.add((4, span))
        return ["\n".join(lines)], Record(column if r.random() < 0.9 else "", email, phone, tuple(known)), truth


def invented_sample(given: list[str], family: list[str], words: WordModel, documents: int, seed: int) -> tuple[Batch, np.ndarray]:
    """Candidates of invented documents and whether each is exactly what was put there."""
    maker = Invented(random.Random(seed), given, family)
    made = [maker.document() for _ in range(documents)]
    batch = describe([(texts, record) for texts, record, _ in made], words)
    y = np.array([(kind, batch.joined[r][a:b]) in made[r][2] for r, kind, a, b in batch.spans], float)
    return batch, y


def sampled_labels(batch: Batch, records: list[Record]) -> np.ndarray:
    """1 and 0 for spans of real rows that the row's own columns and members settle, NaN for all others."""
    y = np.full(len(batch.spans), np.nan)
    longest: dict[int, int] = {}
    for r, kind, a, b in batch.spans:
        if kind == 4 and batch.joined[r][a:b] in records[r].name:
            longest[r] = max(longest.get(r, 0), b - a)
    for k, (r, kind, a, b) in enumerate(batch.spans):
        span, record = batch.joined[r][a:b], records[r]
        digits = "".join(c for c in span if c.isdigit())
        own_phone = "".join(c for c in record.phone if c.isdigit())
        row = batch.rows[k]
        if kind == 0 and span == record.email or kind == 1 and span == record.phone:
            y[k] = 1
        elif kind in (1, 2) and own_phone and digits in own_phone:
            y[k] = 0
        elif kind == 4 and record.name and span in record.name:
            y[k] = float(b - a == longest[r])
        elif kind in (3, 4) and span in record.known or kind == 4 and row[FEATURES[4].index("institution")]:
            y[k] = 0
    return y


@dataclass
class Gate:
    """First stage of the cascade for names: small trees over the words of a span alone, whose result holds wherever the span
    stands. What scores below ``least``, less than any true span that was learned from, goes no further."""

    trees: BoostedTrees
    least: float

    def __call__(self, shapes: np.ndarray) -> np.ndarray:
        return self.trees.margin(shapes) >= self.least


def fit_gate(x: np.ndarray, y: np.ndarray) -> Gate | None:
    if len(set(y.tolist())) < 2:
        return None
    trees = fit_trees(x, y, rounds=GATE_ROUNDS)
    return Gate(trees, float(trees.margin(x[y > 0]).min()) - GATE_SLACK)


@dataclass
class Detector:
    """One calibrated classifier for each kind, the gate before that of names, and the model of name words."""

    words: WordModel
    models: list[Calibrated | None]
    gate: Gate | None = None
    seen: Seen = field(default_factory=Seen, repr=False)

    def find(self, items: list[tuple[list[str], Record]]) -> list[list[tuple[int, int, int, str]]]:
        """Accepted (kind, start, end, text) of each (texts, record), positions within its joined pieces; of spans that
        overlap the most probable is kept, the longer of about equals."""
        batch = describe(items, self.words, self.seen, self.gate)
        out: list[list[tuple[int, int, int, str]]] = [[] for _ in items]
        if not batch.spans:
            return out
        spans = np.array(batch.spans)
        chance = np.zeros(len(spans))
        for kind, model in enumerate(self.models):
            own = np.flatnonzero(spans[:, 1] == kind)
            if model is not None and len(own):
                p = model.probability(np.array([batch.rows[k] for k in own.tolist()]))
                chance[own] = np.where(p >= model.threshold, p, 0)
        kept = np.flatnonzero(chance > 0)
        order = kept[np.lexsort((spans[kept, 2], -(spans[kept, 3] - spans[kept, 2]), -np.round(chance[kept], 1), spans[kept, 0]))]
        taken: dict[int, list[tuple[int, int]]] = {}
        for k in order.tolist():
            r, kind, start, end = batch.spans[k]
            # Spans that were kept do not overlap: only the neighbours of the place need a look.
            own = taken.setdefault(r, [])
            at = bisect(own, (start, end))
            if (at == 0 or own[at - 1][1] <= start) and (at == len(own) or own[at][0] >= end):
                own.insert(at, (start, end))
                out[r].append((kind, start, end, batch.joined[r][start:end]))
        return out


def fit_detector(names: list[str], rows: list[tuple[list[str], Record]], documents: int = INVENTED_DOCUMENTS, seed: int = 7) -> Detector:
    """Detector from invented documents, typed names and sampled rows, repeatable for equal samples.

    Half of the names teach what words of names look like; the invented texts take their names mostly from the other half, so that
    the trees meet names as they will meet those of other rows.
    """
    parted = name_words(names)
    rng = random.Random(seed)
    rng.shuffle(parted)
    half = (len(parted) + 1) // 2
    taught, kept = parted[:half], parted[half:] or parted
    maker = Invented(random.Random(seed + 1), [], [])
    others = [w for texts, record in rows for w in common_words(texts, record)]
    for text in (*(f"{maker.decoy()} {maker.phrase().lower()}" for _ in range(300)), *(s.replace("{v}", "") for group in SENTENCES.values() for s in group.split("|"))):
        others += common_words([text], Record())
    others += [w for p in (*_HOUSES, *_POSTS) for w in map(str.lower, p) for _ in range(3)]
    known_words = [w for own in taught for w in own if w not in FUNCTION_WORDS] + [plain(maker.word()) for _ in range(150)]
    # Frequent names count several times, as the sample's own given names come several times too. The trees learn with half of the
    # names, scoring uses all.
    frequent = [plain(w) for w in (*GIVEN_NAMES, *FAMILY_NAMES)]
    words = fit_words(known_words + frequent[::2] * 3, others)
    all_words = fit_words(known_words + [w for own in parted[half:] for w in own if w not in FUNCTION_WORDS] + frequent * 3, others)
    given, family = [w[0] for w in kept if len(w) > 1 and len(w[0]) > 2], [w[-1] for w in kept if len(w) > 1 and len(w[-1]) > 2]

    made, y_made = invented_sample(given, family, words, documents, seed)
    real = describe(rows, words)
    y_real = sampled_labels(real, [r for _, r in rows])
    known = np.flatnonzero(~np.isnan(y_real))
    rows_of = made.rows + [real.rows[k] for k in known]
    y = np.concatenate([y_made, y_real[known]])
    kinds = np.array([s[1] for s in made.spans] + [real.spans[k][1] for k in known])
    models: list[Calibrated | None] = []
    for kind in range(len(KINDS)):
        own = np.flatnonzero(kinds == kind)
        x = np.array([rows_of[k] for k in own.tolist()])
        models.append(fit_calibrated(x, y[own], rounds=NAME_ROUNDS if KINDS[kind] == "name" else ROUNDS) if len(set(y[own].tolist())) > 1 else None)
    own = np.flatnonzero(kinds == 4)
    first = FEATURES[4].index("length")
    gate = fit_gate(np.array([rows_of[k] for k in own.tolist()])[:, first : first + NAME_SHAPE], y[own]) if len(own) else None
    return Detector(all_words, models, gate)
