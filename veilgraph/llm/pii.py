"""op9: personal data. Patterns propose spans, checksums confirm them, context words adjust their score.

Kinds: email, ip, card (16 to 19 digits, Luhn) and phone are always reported once their own test holds, with their score. iban (mod-97)
and ssn are reported when their score reaches a threshold: words of the kind nearby raise it, words that name another sort of
number (an order, a part, a version) lower it. So an IBAN stands unless its context speaks against it, a bare ddd-dd-dddd only if its context speaks for it.

A null text counts as empty; a null doc_id stays null. Repeated rows are answered each. Extra columns are ignored. Texts of any length go through whole, in time
linear in their length. Spans of one kind don't overlap; of different kinds they may. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, STRING, release, schema, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
THRESHOLD = 0.5
#: Score of a span before its context, words that raise it when within WINDOW characters, and words that lower any kind's.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
}
CONTRARY = frozenset(("order", "invoice", "part", "serial", "version", "isbn", "sku", "tracking", "article", "release", "ticket", "example"))
WINDOW, BOOST = 40, 0.3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a match's local part ends at an @, so each @ is tried with the longest run before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    for m in IP.finditer(text):
        if _ip(m[0]):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", *m.span()
    for m in IBAN.finditer(text):
        own = m[0].replace(" ", "")
        if 15 <= len(own) <= 34 and mod97(own):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        yield "ssn", *m.span()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed in KINDS, then start. Offsets are code points, the end exclusive."""
    out = []
    for kind, a, b in _candidates(text or ""):
        near = set(WORD.findall((text[max(0, a - WINDOW) : a] + " " + text[b : b + WINDOW]).lower()))
        shift = (not near.isdisjoint(CONTEXT[kind])) - (not near.isdisjoint(CONTRARY))
        score = round(min(1.0, max(0.0, PRIOR[kind] + BOOST * shift)), 2)
        if KINDS.index(kind) < BASE or score >= THRESHOLD:
            out.append((kind, a, b, score))
    return out


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind, as [EMAIL]; overlapping spans become one, named by the first."""
    if not text:
        return text
    spans = sorted((a, -b, kind) for kind, a, b, _ in find_spans(text))
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


#: ``scores`` holds a score for each of ``spans``, in the same order.
OUT = schema(doc_id=LONG, n_email=LONG, n_ip=LONG, n_card=LONG, n_phone=LONG, base_sha256=STRING, spans=STRING, scores=STRING)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for text in batch.column("text"):
            spans = find_spans(text.as_py())
            for k in range(BASE):
                cols[k].append(sum(s[0] == KINDS[k] for s in spans))
            base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in KINDS[:BASE])
            cols[4].append(hashlib.sha256(base.encode()).hexdigest())
            cols[5].append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans))
            cols[6].append(",".join(str(s) for *_, s in spans))
        kinds = [pa.int64()] * BASE + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols, kinds)], names=OUT.names)


def report(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_report, OUT)


def redacted(text: Column) -> Column:
    """The column with personal data replaced."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        release()
        changed, new = [], []
        for t in texts:
            text = t.as_py()
            got = redact(text)
            changed.append(got is not text)
            if changed[-1]:  # only these are held as Python strings
                new.append(got)
        return pc.replace_with_mask(texts, pa.array(changed, pa.bool_()), pa.array(new, pa.string()))

    return run(text)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
