"""Paths that address a value in a document: keys joined by dots, array steps in brackets."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = re.compile(r'[.\[\]"\\]')
STEP = re.compile(r'\.?(?:\[("(?:[^"\\]|\\.)*")\]|\[([0-9]*)\]|([^.\[]+))', re.S)


def key_step(path: str, key: str) -> str:
    """path extended by an object key; keys that could be misread stand in brackets, JSON-quoted."""
    if not key or SPECIAL.search(key):
        return f"{path}[{json.dumps(key, ensure_ascii=False)}]"
    return f"{path}.{key}" if path else key


def index_step(path: str, index: int) -> str:
    return f"{path}[{index}]"


def steps(path: str) -> list[str | None]:
    """The keys of a path; None for an array step."""
    out, at = [], 0
    while at < len(path):
        m = STEP.match(path, at)
        if not m or (at == 0 and path[0] == "."  and not m[3] and not m[1] and m[2] is None):
            raise ValueError(f"malformed path at {at}")
        out.append(json.loads(m[1]) if m[1] else m[3])
        at = m.end()
    return out


def _rebuild(path: str, change) -> str:
    out = ""
    for s in steps(path):
        out = f"{out}[]" if s is None else key_step(out, change(s))
    return out


def canonical(path: str) -> str:
    """Array steps without index, keys case-folded: the form in which rules are looked up."""
    return _rebuild(path, str.casefold)


def schema(path: str) -> str:
    """Array steps without index, keys as spelled."""
    return _rebuild(path, lambda k: k)


def prefixes(path: str) -> list[str]:
    """Every prefix of a schema path that ends in a key."""
    out, now = [], ""
    for s in steps(path):
        now = f"{now}[]" if s is None else key_step(now, s)
        if s is not None:
            out.append(now)
    return out


def canonical_plain(path: Column) -> Column:
    """canonical() for ASCII paths without quoted keys."""
    return F.lower(F.regexp_replace(path, r"\[[0-9]+\]", "[]"))
