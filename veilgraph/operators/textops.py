"""Free text through a mapping: scrub (reals to pseudonyms), restore (back), point lookups, and v1's token sweep.

The mapping of one collection comes from a file that the driver holds; it goes to the workers as one broadcast scanner. Rows of text are independent.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pseudonyms import CATEGORIES, normalize

EXACT = ("oids", "opaque")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


class Scanner:
    """Finds the longest of many literals at a place, by length and first characters."""

    def __init__(self, literals, ignore_case: bool):
        self.fold = str.lower if ignore_case else str
        self.by_head: dict[str, dict[int, set[str]]] = {}
        for s in literals:
            s = self.fold(s)
            self.by_head.setdefault(s[:2], {}).setdefault(len(s), set()).add(s)
        self.lengths = {h: sorted(v, reverse=True) for h, v in self.by_head.items()}
        self.heads = re.compile("|".join(map(re.escape, sorted(self.by_head, key=len, reverse=True)))) if self.by_head else None

    def at(self, text: str, low: str, k: int) -> int:
        """The length of the longest literal at k, 0 if there is none."""
        for head in (low[k : k + 2], low[k : k + 1]):
            for n in self.lengths.get(head, ()):
                if low[k : k + n] in self.by_head[head][n]:
                    return n
        return 0

    def next(self, low: str, k: int) -> int:
        """The first place from k on where a literal may start, or -1."""
        m = self.heads.search(low, k) if self.heads else None
        return m.start() if m else -1

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost, longest, without overlaps."""
        low, out = self.lower(text), []
        k = self.next(low, 0)
        while k >= 0:
            n = self.at(text, low, k)
            if n:
                out.append((k, k + n))
            k = self.next(low, k + (n or 1))
        return out

    def lower(self, text: str) -> str:
        low = self.fold(text)
        return low if len(low) == len(text) else "".join(c if len(self.fold(c)) != 1 else self.fold(c) for c in text)


class Text:
    """A mapping ready for text: rows (category, real, pseudonym)."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        rank = {c: k for k, c in enumerate(CATEGORIES)}
        rows = sorted(rows, key=lambda r: rank[r[0]])
        self.to: dict[tuple[str, str], str] = {}
        self.back: dict[str, str] = {}
        exact, folded = set(), set()
        for c, real, fake in rows:
            if not real or not fake:
                continue
            self.to.setdefault((c, normalize(c, real)), fake)
            self.back.setdefault(fake, real)
            (exact if c in EXACT else folded).add(real)
            if c not in EXACT:
                folded.add(real.casefold())
        self.fakes = Scanner(self.back, False)
        self.passes = [(Scanner(exact, False), EXACT), (Scanner(folded, True), tuple(c for c in CATEGORIES if c not in EXACT))]

    def scrub(self, text: str) -> tuple[str, Counter, int]:
        """Whole words only, nothing inside a pseudonym; the text, replacements by category, hits without an owner."""
        counts, unresolved = Counter(), 0
        for scanner, allowed in self.passes:
            taken = bytearray(len(text))
            for a, b in self.fakes.spans(text):
                taken[a:b] = b"\1" * (b - a)
            low, out, done = scanner.lower(text), [], 0
            k = scanner.next(low, 0)
            while k >= 0:
                n = 0 if k and text[k - 1] in WORD else scanner.at(text, low, k)
                got = None
                if n and not (k + n < len(text) and text[k + n] in WORD) and not any(taken[k : k + n]):
                    hit = text[k : k + n]
                    got = next(((c, self.to[c, x]) for c in allowed if (c, x := normalize(c, hit)) in self.to), None)
                    unresolved += got is None
                if got:
                    out += [text[done:k], got[1]]
                    counts[got[0]] += 1
                    done = k + n
                k = scanner.next(low, k + n if got else k + 1)
            out.append(text[done:])
            text = "".join(out)
        return text, counts, unresolved

    def restore(self, text: str) -> str:
        """Longest pseudonym first, as spelled, anywhere."""
        out, at = [], 0
        for a, b in self.fakes.spans(text):
            out += [text[at:a], self.back[text[a:b]]]
            at = b
        return "".join([*out, text[at:]])


def load(registry: DataFrame) -> Text:
    return Text([tuple(r) for r in registry.select("category", "real", "pseudonym").orderBy("category", "norm").collect()])


def _shared(own: Text):
    return SparkSession.active().sparkContext.broadcast(own)


def scrub(text: Column, own: Text) -> Column:
    """struct(text, counts map, unresolved)."""
    shared = _shared(own)

    @F.pandas_udf("text string, counts map<string,long>, unresolved long")
    def run(texts: pd.Series) -> pd.DataFrame:
        scanner = shared.value
        got = [scanner.scrub(t) if t is not None else (None, Counter(), 0) for t in texts]
        return pd.DataFrame({"text": [g[0] for g in got], "counts": [dict(g[1]) for g in got], "unresolved": [g[2] for g in got]})

    return run(text)


def restore(text: Column, own: Text) -> Column:
    shared = _shared(own)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.restore, na_action="ignore")

    return run(text)


def report(scrubbed: DataFrame, col: str = "scrubbed") -> DataFrame:
    """Replacements by category over all rows."""
    return scrubbed.select(F.explode(f"{col}.counts").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("n"))


# --- token sweep -------------------------------------------------------------------------------------------------

#: Beyond so many branches at a place, or places in a row, alternatives are written one after the other.
BRANCHES, NESTED = 64, 64


@lru_cache(maxsize=1)
def case_classes() -> dict[int, str]:
    """For str.translate: each character that the regular expression engine takes for another one, ignoring case, to the one that stands for
    all of them: one that folds to itself, else one in lower case, the least of several."""
    cased = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if len({c, c.lower(), c.upper(), c.casefold()}) > 1)
    known: dict[str, set[str]] = {}
    for c in cased:
        own = set(re.findall(re.escape(c), cased, re.I)) | {c}
        for other in [*own]:
            own |= known.get(other, set())
        known.update(dict.fromkeys(own, own))
    stands = {id(own): min(own, key=lambda c: (c.casefold() != c, c.lower() != c, c)) for own in known.values()}
    return {ord(c): stands[id(own)] for c, own in known.items()}


def one_spelling(text: str) -> str:
    """The same for all texts that match each other character by character, ignoring case."""
    return text.translate(case_classes())


def match_ignoring_case(a: str, b: str) -> bool:
    """Whether one character matches another one."""
    return one_spelling(a) == one_spelling(b)


def signature(text: str) -> tuple[str, ...]:
    """The one spelling's characters, each folded by itself."""
    return tuple(c.casefold() for c in one_spelling(text))


def distinct_ignoring_case(values: list[str]) -> list[str]:
    """Each text in its one spelling, at its first place."""
    return list(dict.fromkeys(map(one_spelling, values)))


def factored(words: list[str], level: int = 0) -> str:
    """A pattern for any of the words, the first that fits; beginnings that several share are written once. Different characters must not match each other."""
    head = os.path.commonprefix(words)
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[len(head) : len(head) + 1], []).append(w[len(head) :])
    if len(words) < 2 or not any(rest):
        return re.escape(head)
    flat = len(rest) > BRANCHES or level >= NESTED
    branches = [re.escape(w[len(head) :]) for w in words] if flat else [factored(own, level + 1) for own in rest.values()]
    return f"{re.escape(head)}(?:{'|'.join(branches)})"


def token_pattern(tokens: list[str]) -> re.Pattern | None:
    """Any of the tokens as a whole word, longest first."""
    own = distinct_ignoring_case(sorted((t for t in tokens if t), key=lambda t: (-len(t), t.casefold())))
    return re.compile(f"(?<![A-Za-z0-9_])(?:{factored(own)})(?![A-Za-z0-9_])", re.I) if own else None


def find_tokens(text: str, tokens: list[str]) -> set[str]:
    """The tokens that stand in the text, as spelled there."""
    pattern = token_pattern(tokens)
    return {m[0] for m in pattern.finditer(text)} if pattern else set()


def sweep(text: str, replacements: dict[str, str]) -> str:
    """Tokens replaced; of two that differ in case only the first counts."""
    own: dict[str, str] = {}
    for real, fake in replacements.items():
        own.setdefault(one_spelling(real), fake)
    pattern = token_pattern(list(replacements))
    return pattern.sub(lambda m: own.get(one_spelling(m[0]), m[0]), text) if pattern else text
