"""Sinks: staged, never overwriting, nothing left behind on failure; the mapping file."""

from __future__ import annotations

import json
import os
import re
import secrets
import shutil
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..functions import jsontext
from ..functions.pseudonyms import CATEGORIES, normalize


class PublishError(ValueError):
    """A destination that may not be written."""


def new_salt() -> str:
    return secrets.token_hex(16)


def guard(source: str, out: str, mapping: str | None) -> None:
    """Destinations must be new, and inside neither the input nor each other."""
    real = [os.path.realpath(p) for p in (source, out, mapping) if p]
    inside = lambda a, b: os.path.commonpath([a, b]) == b
    if any(os.path.lexists(p) for p in real[1:]):
        raise PublishError("destination exists")
    if os.path.isdir(real[0]) and any(inside(p, real[0]) for p in real[1:]) or len(real) > 2 and inside(real[2], real[1]):
        raise PublishError("destination lies inside the input or the output")


def _private(path: str, data: bytes | Iterable[str]) -> None:
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
        f.writelines([data] if isinstance(data, bytes) else (part.encode() for part in data))


def stage(members: Iterable[tuple[str, str]], out: str) -> str:
    """Write members next to out, as a ZIP if out ends in .zip, else as a directory; returns the staged path."""
    staged = f"{out}.{secrets.token_hex(8)}.staging"
    try:
        if out.endswith(".zip"):
            with os.fdopen(os.open(staged, os.O_RDWR | os.O_CREAT | os.O_EXCL, 0o600), "w+b") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
                for name, body in members:
                    info = zipfile.ZipInfo(name, datetime.now(timezone.utc).timetuple()[:6])
                    info.external_attr, info.compress_type = 0o600 << 16, zipfile.ZIP_DEFLATED
                    z.writestr(info, body)
        else:
            os.mkdir(staged, 0o700)
            for name, body in members:
                _private(os.path.join(staged, name), body.encode())
    except BaseException:
        remove(staged)
        raise
    return staged


def remove(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.lexists(path) and os.remove(path)


def rename_new(staged: str, out: str) -> None:
    """Move without replacing: a link, or an empty folder that only a folder can be moved onto, claims the name; both fail if it is taken."""
    try:
        if os.path.isdir(staged):
            os.mkdir(out, 0o700)
            os.rename(staged, out)
        else:
            os.link(staged, out)
            os.remove(staged)
    except FileExistsError as e:
        raise PublishError("destination exists") from e


def publish(members: Iterable[tuple[str, str]], out: str, mapping: tuple[str, Iterable[str]] | None) -> None:
    """mapping: (path, parts of its text). The mapping goes first; if the collection then fails, it is taken back."""
    staged = stage(members, out)
    try:
        if mapping:
            side = f"{mapping[0]}.{secrets.token_hex(8)}.staging"
            try:
                _private(side, mapping[1])
                rename_new(side, mapping[0])
            except BaseException:
                remove(side)
                raise
        try:
            rename_new(staged, out)
        except BaseException:
            if mapping:
                remove(mapping[0])
            raise
    finally:
        remove(staged)


def mapping_parts(registry: DataFrame, salt: str, input_hash: str, policy: dict | None = None, created: str | None = None, aliases: dict[str, str] | None = None) -> Iterator[str]:
    """The mapping as a file, in parts: sorted keys, two spaces, ASCII. Spark sorts the identities, so the driver holds a partition of them at a time. aliases: reverse-only
    SIDs carried on from a reused mapping."""
    old = {"sids": aliases} if aliases else {}
    own = {"created": created or datetime.now(timezone.utc).isoformat(timespec="seconds"), "format_version": jsontext.Number(2), "input_hash": input_hash, "legacy_reverse_aliases": old, "salt": salt}
    if policy is not None:
        own["policy"] = {k: jsontext.Number(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in policy.items()}
    yield '{\n  "categories": {'
    rows = registry.select("category", "real", "pseudonym").orderBy("category", "real").toLocalIterator()
    row = next(rows, None)
    for k, c in enumerate(sorted(CATEGORIES)):
        yield f"{',' if k else ''}\n    {json.dumps(c)}: {{"
        n = 0
        while row is not None and row.category == c:
            yield f"{',' if n else ''}\n      {json.dumps(row.real)}: {json.dumps(row.pseudonym)}"
            row, n = next(rows, None), n + 1
        yield "\n    }" if n else "}"
    if row is not None:
        raise PublishError(f"unknown category {row.category}")
    yield "\n  },"
    yield jsontext.dumps(own, sort=True, indent=2)[1:]  # "categories" sorts before all of them


def mapping_text(registry: DataFrame, salt: str, input_hash: str, policy: dict | None = None, created: str | None = None, aliases: dict[str, str] | None = None) -> str:
    """``mapping_parts`` as one text."""
    return "".join(mapping_parts(registry, salt, input_hash, policy, created, aliases))


def _buckets(own: dict, name: str) -> dict[str, dict[str, str]]:
    got = own.pop(name, None) or {}
    if unknown := sorted(set(got) - set(CATEGORIES)):
        raise PublishError(f"unknown category {unknown[0]}")
    return {c: {a: b for a, b in got.pop(c, {}).items() if isinstance(b, str)} for c in CATEGORIES}


def upgrade_sids(sids: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """SIDs of a mapping of format 1 as those of format 2, and its reverse-only aliases.

    Format 1 kept a domain under its three numbers alone and gave each SID below it a pseudonym as long as a domain's, whose last arc
    is the one in use. One arc below the domain that makes a SID; further below only the pseudonym that was once given out is known, so
    it stays for reversal and the SID is mapped anew.
    """
    whole = re.compile(r"(?i)S-1-5-21(?:-[0-9]+){3}")
    domains = {f"S-1-5-21-{k}": p for k, p in sids.items() if re.fullmatch(r"[0-9]+-[0-9]+-[0-9]+", k) and whole.fullmatch(p)}
    if not domains:
        return sids, {}
    out = {k: p for k, p in sids.items() if not re.fullmatch(r"[0-9]+-[0-9]+-[0-9]+", k)} | domains
    aliases: dict[str, str] = {}
    for real, fake in sids.items():
        arcs = real.split("-")
        home = domains.get("-".join(arcs[:7]).upper())
        if home is None or len(arcs) < 8 or not whole.fullmatch(fake):
            continue
        given = f"{home}-{fake.rpartition('-')[2]}"
        if len(arcs) == 8:
            out[real] = given
        else:
            del out[real]
            if aliases.setdefault(given, real) != real:
                raise PublishError("reverse-only alias has ambiguous owners")
    return out, aliases


def check_aliases(aliases: dict[str, dict[str, str]], sids: dict[str, str]) -> None:
    """Reverse-only aliases are SIDs one arc below a domain whose owners lie deeper, and nobody else's pseudonym."""

    def arcs(sid: str) -> int:
        got = re.fullmatch(r"S-1-5-21((?:-(?:0|[1-9][0-9]*)){4,})", sid)
        return len(sid.split("-")) - 1 if got and all(int(a) < 1 << 32 for a in got[1][1:].split("-")) else 0

    if any(own for c, own in aliases.items() if c != "sids"):
        raise PublishError("reverse-only aliases are for SIDs alone")
    taken, seen = {normalize("sids", p) for p in sids.values()} if aliases.get("sids") else set(), {}
    for fake, real in aliases.get("sids", {}).items():
        if arcs(fake) != 7 or arcs(real) <= 7:
            raise PublishError("reverse-only alias has an invalid SID hierarchy")
        norm = normalize("sids", fake)
        if norm in taken or seen.setdefault(norm, real) != real:
            raise PublishError("reverse-only alias has ambiguous owners")


def _check_head(own: dict, catalog_version: int | None) -> int:
    """The format of a saved mapping; one without a salt, of another format, or made under another catalog version is refused."""
    if not isinstance(own.get("salt"), str):
        raise PublishError("mapping has no salt")
    version = own.get("format_version", 1)
    if version not in (1, 2):
        raise PublishError("unsupported mapping format")
    if catalog_version is not None and (own.get("policy") or {}).get("catalog_version") != catalog_version:
        raise PublishError("mapping was made under another catalog version")
    return version


def saved_rows(path: str, catalog_version: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(category, real, pseudonym) of a whole file as ``mapping_parts`` writes it, an item a line, which isn't held; its other keys are checked after the last row."""
    with open(path, encoding="ascii") as f:
        if f.readline() != "{\n" or f.readline() != '  "categories": {\n':
            raise PublishError("mapping isn't written an item a line")
        category = None
        for line in f:
            if line.startswith("      "):
                ((real, fake),) = json.loads(f"{{{line.rstrip().removesuffix(',')}}}").items()
                yield category, real, fake
            elif line.startswith('    "'):
                category = json.loads(line[: line.rindex('": {') + 1])
            elif line == "  },\n":
                break
        _check_head(json.loads("{" + f.read()), catalog_version)


def load_mapping(path: str, catalog_version: int | None = None) -> dict:
    """A saved mapping, format 1 upgraded. With catalog_version, one made under another version, or under none, is refused."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    version = _check_head(own, None)
    own["categories"], aliases = _buckets(own, "categories"), _buckets(own, "legacy_reverse_aliases")
    if version == 1:
        own["categories"]["sids"], found = upgrade_sids(own["categories"]["sids"])
        for fake, real in found.items():
            if aliases["sids"].setdefault(fake, real) != real:
                raise PublishError("reverse-only alias has ambiguous owners")
    check_aliases(aliases, own["categories"]["sids"])
    own["legacy_reverse_aliases"] = aliases["sids"]
    _check_head(own, catalog_version)
    return own
