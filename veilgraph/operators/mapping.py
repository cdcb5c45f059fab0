"""Values to replacements, and the mapping table of identities that they use.

A replacement is a function of salt and value, so distinct values are replaced where they are, without an allocator; a reused
mapping, which overrides it, is looked up first. Only the last arcs of SIDs are short enough (32 bits) to meet: of those that do,
all but one move on (``settled``). The mapping table is what reversal and verification read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pieces, pseudonyms
from ..functions.pseudonyms import CATEGORIES

FORMS = {
    "domain": pieces.domain, "host": pieces.host, "guid": pieces.guid, "token": pieces.token, "machine": pieces.machine, "address": pieces.address, "dn": pieces.dn, "path_": pieces.path, "url_": pieces.url,
    "oids": lambda v: iter([("oids", v)]), "opaque": lambda v: iter([("opaque", v)]), "cert_templates": lambda v: iter([("cert_templates", v)]),
}
KEPT_FORMS = {"sid": pieces.sid, "shape": pieces.by_shape, "name_at": pieces.name_at_domain, "group_at": pieces.group_at_host}
REPLACED = "form string, token string, arg string, keep boolean, output string, identities array<struct<category:string,real:string,norm:string,pseudonym:string,pseudonym_norm:string>>"
CUT = "form string, token string, arg string, keep boolean, pieces array<struct<category:string,text:string,norm:string>>"


class MappingError(ValueError):
    """A mapping that can't be used: it collides, conflicts, or leaves a value as it was."""


def cut(form: str, token: str, arg: str | None, keep: bool) -> list[pieces.Piece]:
    """A value's pieces."""
    if form == "same":
        return [(None, token)]
    if form == "redacted":
        return [(None, pseudonyms.REDACTED)]
    if form == "literal":
        return [(None, arg)]
    if form == "template_at":
        return list(pieces.template_at_domain(token, arg))
    if form == "dn" and arg:
        names = set(json.loads(arg))
        return list(pieces.dn(token, lambda kind, text: text.casefold() in names))
    if form == "spn":
        own = pieces.spn(token)
        own = None if own is None else list(own)
        return own if own and any(c for c, _ in own) else [("opaque", token)]
    return list(FORMS[form](token)) if form in FORMS else list(KEPT_FORMS[form](token, keep))


def whole(own: list[pieces.Piece]) -> list[pieces.Piece]:
    """Pieces with each SID as one."""
    out: list[pieces.Piece] = []
    for c, t in own:
        if c in ("arc", "kept_arc"):
            out[-1] = ("sids", t)
        else:
            out.append((c, t))
    return out


class Replacer:
    def __init__(self, salt: str, owned: dict[tuple[str, str], str]):
        self.salt, self.owned = salt, owned

    def name(self, category: str, real: str) -> str:
        return self.owned.get((category, pseudonyms.normalize(category, real))) or pseudonyms.pseudonym(self.salt, category, real)

    def __call__(self, form: str, token: str, arg: str | None, keep: bool) -> tuple[str, list[tuple]]:
        out, seen, sid = "", [], ""
        for c, text in cut(form, token, arg, keep):
            if c is None:
                out += text
                continue
            if c in ("arc", "kept_arc"):
                last = text.rpartition("-")[2] if c == "kept_arc" else pseudonyms.arc(self.salt, text)
                got = self.owned.get(("sids", text.casefold())) or f"{sid}-{last}"
                out, sid, c = out[: len(out) - len(sid)] + got, got, "sids"
            else:
                got = self.name(c, text)
                sid = got if c == "sids" else ""
                out += got
            seen.append((c, text, pseudonyms.normalize(c, text), got, pseudonyms.normalize(c, got)))
        return out, seen


def distinct_values(decided: DataFrame) -> DataFrame:
    return decided.select("form", "token", "arg", "keep").distinct()


def replacements(values: DataFrame, salt: str, owned: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Each distinct (form, token, arg, keep) with its output and the identities it used."""
    names = [f.split()[0] for f in REPLACED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replace = Replacer(salt, owned or {})
        keys = ("category", "real", "norm", "pseudonym", "pseudonym_norm")
        for b in batches:
            rows = []
            for form, token, arg, keep in b[["form", "token", "arg", "keep"]].itertuples(index=False):
                out, seen = replace(form, token, arg if isinstance(arg, str) else None, bool(keep))
                rows.append((form, token, arg, keep, out, [dict(zip(keys, s)) for s in seen]))
            yield pd.DataFrame(rows, columns=names)

    return values.select("form", "token", "arg", "keep").mapInPandas(run, REPLACED)


def moved_sids(replaced: DataFrame, owned: dict[tuple[str, str], str]) -> dict[tuple[str, str], str]:
    """New pseudonyms for SIDs below a domain that share one, of those nearest to the domain; empty if none do.

    One of a reused mapping stays, then one whose last arc is kept, then the least; the others take the next arcs that are free. Rows of ``owned`` never move.
    The driver holds them: about n * n / 2**33 of a domain's n SIDs.
    """
    spark = replaced.sparkSession
    found = replaced.select(F.explode("identities").alias("i")).where("i.category = 'sids'").select("i.norm", "i.pseudonym", "i.pseudonym_norm")
    saved = [(n, p, pseudonyms.normalize("sids", p)) for (c, n), p in owned.items() if c == "sids"]
    if saved:
        found = found.union(spark.createDataFrame(saved, found.schema))
    found = found.groupBy("pseudonym_norm", "norm").agg(F.min("pseudonym").alias("pseudonym"))
    arcs = F.size(F.split("pseudonym_norm", "-"))
    shared = found.where(arcs > 7).groupBy("pseudonym_norm").agg(arcs.alias("arcs"), F.collect_list(F.struct("norm", "pseudonym")).alias("own")).where(F.size("own") > 1).collect()
    nearest, last, moving = min((r.arcs for r in shared), default=0), lambda v: v.rpartition("-")[2], []
    for r in sorted((r for r in shared if r.arcs == nearest), key=lambda r: r.pseudonym_norm):
        order = sorted((("sids", x.norm) not in owned, last(x.norm) != last(x.pseudonym), x.norm, x.pseudonym) for x in r.own)
        moving += [(norm, fake) for new, changed, norm, fake in order[1:] if new and changed]
    done: dict[tuple[str, str], str] = {}
    given: set[str] = set()
    while moving:
        tries = {}
        for norm, fake in moving:
            home, _, at = fake.rpartition("-")
            nexts = [at := pseudonyms.next_arc(at) for _ in range(16)]
            tries[norm] = [f"{home}-{a}" for a in nexts]
        asked = spark.createDataFrame([(p.casefold(),) for t in tries.values() for p in t], "pseudonym_norm string").distinct()
        taken = given | {r.pseudonym_norm for r in found.join(F.broadcast(asked), "pseudonym_norm", "left_semi").select("pseudonym_norm").collect()}
        later = []
        for norm, own in tries.items():
            free = next((p for p in own if p.casefold() not in taken and last(p) != last(norm)), None)
            if free is None:
                later.append((norm, own[-1]))
                continue
            done["sids", norm] = free
            given.add(free.casefold())
            taken.add(free.casefold())
        moving = later
    return done


def settled(values: DataFrame, salt: str, owned: dict[tuple[str, str], str], freeze) -> DataFrame:
    """``replacements`` in which no two SIDs below a domain share a pseudonym, whatever the order of rows. freeze: writes a table that is read again.

    SIDs nearest to the domain come first, as those below them move along; values that name a moved one are replaced again, the others stay as they are.
    """
    own, key = freeze(replacements(values, salt, owned), "values"), ("form", "token", "arg", "keep")
    while moved := moved_sids(own, owned):
        owned = owned | moved
        sids = F.broadcast(values.sparkSession.createDataFrame([(n,) for _, n in moved], "norm string"))
        again = own.select(*key, F.explode("identities").alias("i")).where("i.category = 'sids'").withColumn("norm", F.col("i.norm")).join(sids, "norm", "left_semi").select(*key).distinct()
        rest = own.alias("a").join(again.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left_anti")
        own = freeze(rest.unionByName(replacements(again, salt, owned)), "values")
    return own


def key_identities(leaves: DataFrame, salt: str, owned: dict[str, str] | None = None) -> DataFrame:
    """Identities of renamed keys."""
    keys = leaves.where("kind = 'key'").select(F.lit("opaque").alias("form"), "token", F.lit(None).cast("string").alias("arg"), F.lit(False).alias("keep")).distinct()
    return identities(replacements(keys, salt, {("opaque", k): v for k, v in (owned or {}).items()}))


def identities(replaced: DataFrame) -> DataFrame:
    return replaced.select(F.explode("identities").alias("i")).select("i.*").distinct()


def _spelling():
    """Prefer the folded spelling, then order; templates go by plain order."""
    template = F.col("category") == "cert_templates"
    return F.struct(F.when(~template, F.col("norm")).alias("a"), (~template & (F.col("real") != F.col("norm"))).alias("b"), F.col("real").alias("c"))


def registry(found: DataFrame) -> DataFrame:
    """(category, norm, real, pseudonym, pseudonym_norm, variants): one row for each identity, in its preferred spelling."""
    got = found.groupBy("category", "norm").agg(F.min(_spelling()).alias("s"), F.min("pseudonym").alias("pseudonym"), F.min("pseudonym_norm").alias("pseudonym_norm"), F.count_distinct("pseudonym_norm").alias("variants"))
    return got.select("category", "norm", F.col("s.c").alias("real"), "pseudonym", "pseudonym_norm", "variants")


def problems(registry_: DataFrame) -> DataFrame:
    """(category, problem, n): identities that map to themselves, to two pseudonyms, or share one. Empty for a sound table."""
    self_ = registry_.where("norm = pseudonym_norm").select("category", F.lit("leaves its source unchanged").alias("problem"))
    split = registry_.where("variants > 1").select("category", F.lit("conflicts with structured output").alias("problem"))
    shared = registry_.groupBy("category", "pseudonym_norm").count().where("count > 1").select("category", F.lit("pseudonym collision").alias("problem"))
    return self_.union(split).union(shared).groupBy("category", "problem").agg(F.count("*").alias("n"))


def category_rank():
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))


def category_counts(registry_: DataFrame) -> DataFrame:
    return registry_.groupBy("category").agg(F.count("*").alias("n")).orderBy(category_rank())


def reverse(registry_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(pseudonym) -> the reals behind each, by category."""
    exploded = asked.select("pseudonym", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), _norm(c, "pseudonym").alias("pseudonym_norm")) for c in CATEGORIES])).alias("k")).select(F.col("pseudonym").alias("asked"), "k.*")
    return exploded.join(registry_, ["category", "pseudonym_norm"]).select("asked", "category", "real")


def forward(registry_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(real) -> its pseudonyms, by category."""
    exploded = asked.select("real", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), _norm(c, "real").alias("norm")) for c in CATEGORIES])).alias("k")).select(F.col("real").alias("asked"), "k.*")
    return exploded.join(registry_, ["category", "norm"]).select("asked", "category", "pseudonym")


def _norm(category: str, col: str):
    from ..functions.shapes import fold

    v = F.col(col)
    if category == "opaque":
        return v
    if category == "oids":
        return F.when(v.rlike(r"\A[0-9]+(?:\.[0-9]+)+\z"), F.regexp_replace(v, r"(?<=\.|^)0+(?=[0-9])", "")).otherwise(v)
    if category == "guids":
        bare = F.replace(F.regexp_replace(v, r"\A\{(.*)\}\z", "$1"), F.lit("-"), F.lit(""))
        return F.when(bare.rlike(r"\A[0-9a-fA-F]{32}\z"), F.lower(bare)).otherwise(fold(v))
    return fold(v)


def owners(registry_: DataFrame) -> DataFrame:
    """(pseudonym, real): the first category's owner of each pseudonym."""
    w = Window.partitionBy("pseudonym").orderBy(category_rank(), "norm")
    return registry_.where("pseudonym <> ''").withColumn("k", F.row_number().over(w)).where("k = 1").select("pseudonym", "category", "real")


def from_map(spark: SparkSession, saved: dict) -> DataFrame:
    """A saved mapping as a mapping table."""
    rows = [(c, pseudonyms.normalize(c, r), r, p, pseudonyms.normalize(c, p), 1) for c, own in saved["categories"].items() for r, p in own.items() if isinstance(p, str)]
    return spark.createDataFrame(rows, "category string, norm string, real string, pseudonym string, pseudonym_norm string, variants long")


def reversals(spark: SparkSession, saved: dict) -> DataFrame:
    """A saved mapping for reversal: with the aliases that have no forward direction."""
    rows = [("sids", pseudonyms.normalize("sids", r), r, p, pseudonyms.normalize("sids", p), 1) for p, r in saved.get("legacy_reverse_aliases", {}).items()]
    own = from_map(spark, saved)
    return own.union(spark.createDataFrame(rows, own.schema)) if rows else own


def real_tokens(registry_: DataFrame, saved: dict | None = None) -> DataFrame:
    """Each real once, with those that only aliases of a reused mapping stand for, in code point order."""
    own, owners_ = registry_.select("real"), sorted(set((saved or {}).get("legacy_reverse_aliases", {}).values()))
    aliases = registry_.sparkSession.createDataFrame([(r,) for r in owners_], "real string")
    return own.union(aliases).distinct().orderBy("real")


def check_reuse(registry_: DataFrame, saved: dict) -> None:
    """A new pseudonym may not be one that an alias of the reused mapping stands for."""
    aliases = [(pseudonyms.normalize("sids", p),) for p in saved.get("legacy_reverse_aliases", {})]
    if aliases and not registry_.where("category = 'sids'").join(registry_.sparkSession.createDataFrame(aliases, "pseudonym_norm string"), "pseudonym_norm", "left_semi").isEmpty():
        raise MappingError("sids: pseudonym collision with a reverse-only alias")


def hierarchy_faults(registry_: DataFrame) -> DataFrame:
    """SIDs below a domain that have more or fewer arcs than their pseudonym, or whose pseudonym stands elsewhere than below that of the SID above."""
    own = registry_.where("category = 'sids'").select("norm", "pseudonym_norm")
    above = lambda c: F.regexp_replace(c, r"-[0-9]+\z", "")
    arcs = lambda c: F.size(F.split(c, "-"))
    below = own.where(F.col("norm").rlike(r"\As-1-5-21(?:-[0-9]+){4,}\z")).withColumn("parent", above("norm"))
    got = below.join(own.select(F.col("norm").alias("parent"), F.col("pseudonym_norm").alias("above")), "parent", "left")
    return got.where((arcs("norm") != arcs("pseudonym_norm")) | (F.col("above") != above("pseudonym_norm"))).select("norm", "pseudonym_norm")


def check_hierarchy(registry_: DataFrame) -> None:
    """A damaged mapping is refused."""
    if not hierarchy_faults(registry_).isEmpty():
        raise MappingError("sids: inconsistent SID hierarchy")


def fingerprint(registry_: DataFrame) -> tuple:
    """A digest of the table that no order or partitioning changes."""
    h = F.xxhash64("category", "norm", "real", "pseudonym", "pseudonym_norm", "variants").cast("decimal(38,0)")
    return tuple(registry_.agg(F.count("*"), F.sum(h), F.bit_xor(F.xxhash64("pseudonym_norm", "real", "category"))).first())
