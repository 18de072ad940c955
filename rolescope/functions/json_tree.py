"""Nodes of a JSON document in preorder, for any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

KINDS = ("object", "array", "string", "number", "boolean", "null", "malformed")
_OBJECT, _ARRAY, _STRING, _NUMBER, _BOOLEAN, _NULL, _MALFORMED = range(len(KINDS))


class Number(str):
    """Digits of a number as written."""


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=Number)
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))', re.S)
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """Parser without recursion, for nesting beyond the interpreter's stack."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    at, n = 0, len(text.rstrip())
    expect_key = False

    def put(value) -> None:
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value

    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at = m.end()
        mark, string, number, word = m.groups()
        if mark in ("{", "["):
            value: dict | list = {} if mark == "{" else []
            put(value)
            stack.append(value)
            keys.append(None)
            expect_key = mark == "{"
        elif mark in ("}", "]"):
            if len(stack) == 1 or isinstance(stack[-1], dict) != (mark == "}"):
                raise ValueError("no JSON")
            stack.pop()
            keys.pop()
            expect_key = False
        elif mark == ",":
            expect_key = isinstance(stack[-1], dict)
        elif mark == ":":
            expect_key = False
        elif string is not None and expect_key:
            keys[-1] = json.loads(string)
        else:
            put(json.loads(string) if string is not None else Number(number) if number is not None else _WORDS[word])
    if len(stack) != 1 or len(root) != 1:
        raise ValueError("no JSON")
    return root[0]


def parse(text: str):
    """Value of a JSON text; a string that itself holds a JSON object or array is opened. ValueError if malformed."""
    value = _decoded(text)
    while type(value) is str and value.lstrip()[:1] in ("{", "["):
        try:
            value = _decoded(value)
        except ValueError:
            break
    return value


def _decoded(text: str):
    try:
        return _DECODER.decode(text.strip() if text[:1].isspace() else text)
    except RecursionError:
        return _parse_deep(text)


def nodes(value, members: frozenset[str] | None = None) -> Iterator[tuple[int, int, str | None, int, int, str | None]]:
    """(node, parent, label, ordinal, kind, scalar) of each node; the root is node 0 with parent -1.

    Members of objects are labelled by their key, elements of arrays have no label; ``ordinal`` is the place among the
    siblings from 0. ``members`` keeps only these members of the root object, with all that is below them.
    """
    stack: list = [(value, -1, None, 0)]
    node = 0
    while stack:
        v, parent, label, ordinal = stack.pop()
        if isinstance(v, dict):
            pairs = [(k, x) for k, x in v.items() if node or members is None or k in members]
            yield node, parent, label, ordinal, _OBJECT, None
            stack.extend((x, node, k, i) for i, (k, x) in zip(range(len(pairs) - 1, -1, -1), reversed(pairs), strict=True))
        elif isinstance(v, list):
            yield node, parent, label, ordinal, _ARRAY, None
            stack.extend((v[i], node, None, i) for i in range(len(v) - 1, -1, -1))
        elif v is None:
            yield node, parent, label, ordinal, _NULL, None
        elif v is True or v is False:
            yield node, parent, label, ordinal, _BOOLEAN, "true" if v else "false"
        elif isinstance(v, Number):
            yield node, parent, label, ordinal, _NUMBER, str(v)
        else:
            yield node, parent, label, ordinal, _STRING, v
        node += 1


def document_nodes(text: str | None, members: frozenset[str] | None = None) -> Iterator[tuple]:
    """Nodes of a JSON text; none for null, a single ``malformed`` root for a text that is no JSON."""
    if text is None:
        return
    try:
        value = parse(text)
    except ValueError:
        yield 0, -1, None, 0, _MALFORMED, None
        return
    yield from nodes(value, members)
