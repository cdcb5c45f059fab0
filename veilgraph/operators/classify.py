"""What an object is: its node type, and the built-in catalog entry it stands for, strongest evidence first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import domain_rid, fold
from ..plans import tables
from .flatten import DATA


def node_type(meta_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in tables.NODE_TYPES.items() for x in kv])
    return F.coalesce(pairs[fold(meta_type)], F.lit("Unknown"))


def contexts(objects: DataFrame) -> DataFrame:
    """objects with node_type, privacy and catalog_rule_id."""
    spark = objects.sparkSession
    entries = F.broadcast(tables.catalog_frame(spark).where("kind <> 'OID'"))  # the catalog's few thousand rows
    own = objects.withColumn("node_type", node_type(F.col("meta_type")))
    before = F.nullif(F.regexp_extract("name", r"(?s)\A(.+)@[^@]+\z", 1), F.lit(""))
    tries = [
        (1, "SID", F.upper("object_identifier")), (2, "RID", domain_rid(F.col("object_identifier"))), (3, "GUID", F.lower("object_identifier")), (4, "WKGUID", F.lower("wkguid")),
        (5, "TEMPLATE", fold(F.col("templatename"))), (6, "TEMPLATE", F.when(F.col("node_type") == "CertTemplate", fold(before))),
    ]
    keys = F.filter(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), v.alias("value")) for k, kind, v in tries]), lambda x: x.value.isNotNull())
    probe = own.where((F.col("part") == DATA) & (F.col("node_type") != "Unknown")).select("member", "part", "idx", "node_type", F.explode(keys).alias("t"))
    met = probe.join(entries, (F.col("t.kind") == F.col("kind")) & (F.col("t.value") == F.col("value")) & (F.col("node_type") == F.col("entry_type")))
    met = met.where("kind <> 'GUID' or at_identifier")
    best = met.groupBy("member", "part", "idx").agg(F.min(F.struct("t.rank", "entry_id", "entry_privacy")).alias("b"))
    privacy = F.when(F.col("node_type") == "Unknown", "unknown").otherwise(F.coalesce("b.entry_privacy", F.lit("custom")))
    return own.join(best, ["member", "part", "idx"], "left").withColumn("privacy", privacy).withColumn("catalog_rule_id", F.col("b.entry_id")).drop("b")


def sid_privacy(sid: Column) -> Column:
    """The privacy class of a whole SID; a domain's SIDs are never global."""
    pairs = F.create_map(*[F.lit(x) for e in tables.catalog() if e.kind == "SID" for x in (e.value, e.privacy)])
    return F.when(F.upper(sid).startswith("S-1-5-21-"), "custom").otherwise(F.coalesce(pairs[F.upper(sid)], F.lit("unknown")))


def is_builtin_name(name: Column) -> Column:
    """An exact name of a built-in principal, object or template."""
    return fold(F.trim(name)).isin(*sorted(tables.core_names()))


def is_builtin_rid(rid: Column) -> Column:
    return rid.cast("string").isin(*[e.value for e in tables.catalog() if e.kind == "RID" and e.privacy == tables.CORE])


def is_wellknown_guid(guid: Column) -> Column:
    """The null GUID or a default policy's."""
    return F.lower(F.trim(guid)).isin(*sorted({e.value for e in tables.catalog() if e.rule_id == "guid.null" or e.rule_id.startswith("gpo.")}))


def is_core_constant(node: str, kind: str, identifier: str, path: str, value: str | None = None) -> bool:
    """The catalog keeps this value (the identifier itself, if none is given) at this path."""
    own = next((e for e in tables.catalog() if e.kind == kind and e.value == tables.normal(kind, identifier) and node in e.node_types), None)
    return own is not None and own.privacy == tables.CORE and dict(own.keep).get(path) == (identifier if value is None else value).casefold()
