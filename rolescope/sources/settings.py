"""Settings: a variable of the environment beats a file of key=value lines, and that beats the default."""

from __future__ import annotations

import os
import re

_NAME = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def read_env_file(path: str) -> dict[str, str]:
    """Pairs of a file; blank lines, comments and lines without = are skipped, quotes around a value dropped. A file
    that is not there holds none."""
    out: dict[str, str] = {}
    if not os.path.isfile(path):
        return out
    with open(path, encoding="utf-8") as file:
        for line in file:
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                key, value = line.split("=", 1)
                out[key.strip()] = value.strip().strip("\"'")
    return out


def resolve(name: str, default: str | None = None, file_values: dict[str, str] | None = None, environment: dict[str, str] | None = None) -> str | None:
    env = os.environ if environment is None else environment
    return env.get(name) or (file_values or {}).get(name) or default


def identifier(name: str) -> str:
    """A table or column name, unchanged; ValueError for anything that is no plain identifier."""
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def suffix_list(value: str) -> tuple[str, ...]:
    """File suffixes of a comma-separated setting, dots added, in small letters."""
    parts = (p.strip().lower() for p in value.split(","))
    return tuple(p if p.startswith(".") else f".{p}" for p in parts if p)
