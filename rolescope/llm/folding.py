"""Folding of characters that readers take for one another."""

from __future__ import annotations

import re
import unicodedata

# Letters that look like ASCII letters, and the letters they look like.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏᴀοαιν", "aeopcyxijsdhlaoaiv")
# Letters that decomposition leaves whole, and their usual ASCII spelling.
WHOLE = str.maketrans({"ß": "ss", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})
#: Soft hyphens, zero-width marks and direction marks.
INVISIBLE = re.compile("[­​-‏⁠﻿]")


def plain(text: str) -> str:
    """Lower-cased text without accents, invisible marks and look-alike letters."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))
    text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower().translate(LOOKALIKE).translate(WHOLE)


def damerau(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, change, swap of neighbours) between two strings, ``most + 1`` where they are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > most:
            return most + 1
        older, row = row, new
    return min(row[-1], most + 1)
