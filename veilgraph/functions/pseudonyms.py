"""Pseudonyms: a keyed digest of (salt, category, normalized value), written in the category's own form."""

from __future__ import annotations

import base64
import hashlib
import re

# Categories in their order, word lists, suffixes.
CATEGORIES = ("domains", "sids", "accounts", "hosts", "guids", "cert_templates", "oids", "opaque")
COMPANIES = "northwind contoso fabrikam tailspin wingtip adventureworks proseware litware woodgrove margie alpine coho fourthcoffee graphicdesign humongous lucerne nod southridge trey wide".split()
SURNAMES = "franklin hamilton jefferson adams madison monroe jackson harrison tyler polk taylor fillmore pierce buchanan lincoln johnson grant hayes garfield arthur".split()
SUFFIXES = ("example", "invalid", "local", "test")
REDACTED = "[REDACTED]"
FIRST_ARC = 1_000_000


def normalize(category: str, value: str) -> str:
    """The identity of a value: equal results get equal pseudonyms."""
    if category == "opaque":
        return value
    if category == "oids":
        return re.sub(r"(?:(?<=\.)|\A)0+(?=[0-9])", "", value) if re.fullmatch(r"[0-9]+(?:\.[0-9]+)+", value) else value
    if category == "guids":
        bare = (value[1:-1] if len(value) > 1 and value[0] == "{" and value[-1] == "}" else value).replace("-", "")
        if re.fullmatch(r"[0-9a-fA-F]{32}", bare):
            return bare.lower()
    return value.casefold()


def seed(salt: str, category: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}|{category}|{normalize(category, value)}".encode(), digest_size=16).digest(), "big")


def mark(number: int) -> str:
    """The seed's upper half in lower-case base32."""
    return base64.b32encode((number >> 64).to_bytes(8, "big")).decode().rstrip("=").lower()


def finding_mark(salt: str, value: str) -> str:
    """A short keyed digest that stands for an offending value in findings."""
    return hashlib.blake2b(f"{salt}\x1ffinding\x1f{value}".encode(), digest_size=6).hexdigest()


def _domain(n: int, real: str) -> str:
    suffix = real.rpartition(".")[2].lower() if "." in real else ""
    return f"{COMPANIES[n % len(COMPANIES)]}-{mark(n)}" + (f".{suffix if suffix in SUFFIXES else 'local'}" if "." in real else "")


def _guid(n: int, _: str) -> str:
    h = f"{n:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


FORMS = {
    "domains": _domain,
    "accounts": lambda n, _: chr(97 + n // 97 % 26) + SURNAMES[n % len(SURNAMES)][:6] + mark(n),
    "hosts": lambda n, _: f"HOST-{n % 90 + 10}-{mark(n).upper()}",
    "sids": lambda n, _: "S-1-5-21-" + "-".join(str(n >> shift & 0xFFFFFFFF) for shift in (0, 16, 32)),
    "guids": _guid,
    "cert_templates": lambda n, _: f"Template-{mark(n)}",
    "oids": lambda n, _: f"2.25.{n}",
    "opaque": lambda n, _: f"[REDACTED:{mark(n)}]",
}


def pseudonym(salt: str, category: str, real: str) -> str:
    return FORMS[category](seed(salt, category, real), real)


def arc(salt: str, sid: str) -> str:
    """The last arc that replaces a SID's own; never the same."""
    span = (1 << 32) - FIRST_ARC
    n = seed(salt, "sids", sid) % span
    last = sid.rpartition("-")[2]
    if last.isdigit() and int(last) == n + FIRST_ARC:
        n = (n + 1) % span
    return str(n + FIRST_ARC)


def next_arc(last: str) -> str:
    """The last arc after one that is taken."""
    return str(FIRST_ARC + (int(last) - FIRST_ARC + 1) % ((1 << 32) - FIRST_ARC))
