"""JSON with number tokens kept as written and a canonical ASCII rendering."""

from __future__ import annotations

import json
from typing import Any


class Number(str):
    """A number's token."""

    __slots__ = ()


def _refuse(token: str):
    raise ValueError(f"not JSON: {token}")


def parse(text: str | bytes) -> Any:
    """Objects keep their order, of repeated keys the last value counts; NaN, infinities and lone surrogates are refused."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    got = json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_refuse)
    if "\\ud" in text.lower():
        json.dumps(got, ensure_ascii=False).encode("utf-8")
    return got


def dumps(value: Any, sort: bool = False, indent: int | None = None, level: int = 0) -> str:
    """``", "`` and ``": "`` between items, ASCII only, tokens as they are; sorted and indented on request."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, (dict, list)) and value:
        own = sorted(value.items()) if sort and isinstance(value, dict) else value.items() if isinstance(value, dict) else value
        parts = [f"{json.dumps(x[0])}: {dumps(x[1], sort, indent, level + 1)}" if isinstance(value, dict) else dumps(x, sort, indent, level + 1) for x in own]
        a, b = "{}" if isinstance(value, dict) else "[]"
        if indent is None:
            return a + ", ".join(parts) + b
        pad = "\n" + " " * indent * (level + 1)
        return a + pad + ("," + pad).join(parts) + "\n" + " " * indent * level + b
    return json.dumps(value)


def kind(value: Any) -> str:
    if isinstance(value, dict):
        return "mapping"
    if isinstance(value, list):
        return "list"
    if isinstance(value, Number):
        return "float" if set("eE.") & set(value) else "int"
    return "null" if value is None else "bool" if isinstance(value, bool) else "string"
