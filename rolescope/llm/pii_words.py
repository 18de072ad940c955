"""How much a word looks like part of a person's name: a linear classifier over the letters of the word.

Fitted on a bounded sample of names and of ordinary words, it judges every word by the same weights, known or not, so
scoring needs no table of names and behaves alike at every size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from .folding import plain

#: Slots of the weights, and words whose value a worker remembers.
SLOTS, CACHE_WORDS = 1 << 15, 200_000
#: Rounds over the sample, step and shrinkage of the fit.
ROUNDS, RATE, SHRINK = 300, 0.5, 2e-5
# Words that join others, and names of months and days, in the languages of the corpus.
FUNCTION_WORDS = frozenset(
    "a an the my our your his her their this that these those and or but nor so yet of in on at to by for from with without as is are was were "
    "be been has have had do does did not no all both each every who whom which what when where while since until after before during about into "
    "over under between please thanks dear see also i we you he she they it its me him us them here there "
    "der die das den dem des ein eine einen einem einer und oder aber mit von zu zum zur im am bei nach aus auf für ist war sind wir ich sie er es "
    "le la les un une des du de et ou mais avec sans pour par sur dans chez est était nous vous il elle ils mon ma mes notre "
    "jan feb mar apr jun jul aug sep sept oct nov dec january february march april july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday "
    "el los las uno una y o pero con sin para por en al del es era son fue nos mi su sus nuestro junto".split()
)


def grams(word: str) -> list[int]:
    """Slots of a folded word: itself, its beginnings and ends, and its runs of three letters."""
    bound = f"^{word}$"
    parts = {f"={word}", *(f"<{word[:k]}" for k in (1, 2, 3, 4) if len(word) >= k), *(f">{word[-k:]}" for k in (1, 2, 3, 4) if len(word) >= k)}
    parts.update(bound[k : k + 3] for k in range(len(bound) - 2))
    return [zlib.crc32(p.encode()) % SLOTS for p in sorted(parts)]


@dataclass
class WordModel:
    """Weights of the slots; ``look`` gives the log-odds of a word, 0 where nothing is known."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.float32))
    base: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def look(self, word: str) -> float:
        """Log-odds that a word, as written, is part of a name, between -8 and 8."""
        found = self.known.get(word)
        if found is None:
            folded = plain(word)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            total = float(self.weights[grams(folded)].mean()) * 8 + self.base if len(folded) > 1 else 0.0
            found = self.known[word] = -8.0 if folded in FUNCTION_WORDS else max(-8.0, min(8.0, round(total, 3)))
        return found


def fit_words(names: Iterable[str], others: Iterable[str]) -> WordModel:
    """Model of folded words that are parts of names and of words that are not; a word that is both counts as what it is more
    often. Without one of the two, every word is as likely as not."""
    counts: dict[str, list[int]] = {}
    for k, words in enumerate((others, names)):
        for w in words:
            if len(w) > 1:
                counts.setdefault(w, [0, 0])[k] += 1
    rows = [(w, n > o) for w, (o, n) in sorted(counts.items()) if n != o]
    y = np.array([t for _, t in rows], float)
    if not len(y) or y.min() == y.max():
        return WordModel()
    slots = [grams(w) for w, _ in rows]
    owner = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
    flat = np.concatenate(slots)
    share = 8.0 / np.array([len(s) for s in slots], float)
    # Both classes weigh the same.
    importance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weights, squares, base = np.zeros(SLOTS), np.full(SLOTS, 1e-6), 0.0
    for _ in range(ROUNDS):
        margin = np.bincount(owner, weights[flat], len(rows)) * share + base
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * importance
        g = np.bincount(flat, (slope * share)[owner], SLOTS) / len(rows) + SHRINK * weights
        squares += g * g
        weights -= RATE * g / np.sqrt(squares)
        base -= RATE * slope.mean()
    return WordModel(weights.astype(np.float32), float(base))
