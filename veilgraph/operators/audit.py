"""Counts of what was decided; no value is kept."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import tables

CORE_TYPES = ("users", "computers", "groups", "domains")


def audit(contexts: DataFrame, decided: DataFrame, leaves: DataFrame, numbers: DataFrame) -> DataFrame:
    """(section, item, n): one pass over each table."""
    objects = contexts.where("part = 1")
    by = lambda df, section, item: df.groupBy(item.alias("item")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "item", "n")
    keys = leaves.where("kind = 'key'").select(F.lit("unknown-key-path").alias("code"), _lookup(F.col("record")).alias("path"))
    codes = decided.where("audit_code is not null").select(F.col("audit_code").alias("code"), F.when(F.col("audit_code").startswith("unknown-"), _lookup(F.col("record"))).alias("path"))
    undeclared = numbers.where("undeclared").select(F.lit("undeclared-numeric-value").alias("code"), F.lit(None).cast("string").alias("path"))
    unknown = objects.where("node_type = 'Unknown'").select(F.lit("unknown-node-type").alias("code"), F.lit(None).cast("string").alias("path"))
    coded = keys.union(codes).union(undeclared).union(unknown)
    return (
        by(objects, "object_classifications", F.col("privacy")).union(by(decided, "privacy_classes", F.col("privacy"))).union(by(decided, "operations", F.col("operation")))
        .union(by(decided, "rule_ids", F.col("rule_id"))).union(by(coded, "audit_codes", F.col("code"))).union(by(coded.where("path is not null"), "unknown_paths", F.col("path")))
        .union(by(numbers.where("undeclared"), "numeric_passthrough_paths", _lookup(F.col("record"))))
    )


def _lookup(record):
    from ..functions import paths

    @F.pandas_udf("string")
    def run(records: pd.Series) -> pd.Series:
        return records.map({r: paths.canonical(r) for r in records.unique()})

    return run(record)


def summary(counts: DataFrame) -> dict:
    """The audit as nested sorted maps; the last only if there is something to say."""
    names = ["object_classifications", "privacy_classes", "operations", "rule_ids", "audit_codes", "unknown_paths", "numeric_passthrough_paths"]
    own: dict[str, dict[str, int]] = {n: {} for n in names}
    for r in counts.orderBy("section", "item").collect():
        own[r.section][r["item"]] = r.n
    own = {k: dict(sorted(v.items())) for k, v in own.items()}
    if not own[names[-1]]:
        del own[names[-1]]
    return own


def top(counts: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent unknown paths, then by name."""
    return counts.where("section = 'unknown_paths'").orderBy(F.desc("n"), "item").limit(n)


def skipped(members: DataFrame, objects: DataFrame) -> DataFrame:
    """Members that are no collection documents, in order."""
    return members.select("member").join(objects.where("part = 0").select("member"), "member", "left_anti").orderBy("member")


def type_rows(objects: DataFrame) -> DataFrame:
    """Objects by collection type and version."""
    from .classify import node_type

    version = F.get_json_object("body", "$.version").alias("version")
    return objects.where("part = 0").groupBy("meta_type", node_type(F.col("meta_type")).alias("node_type"), version).agg(F.sum("items").alias("objects"), F.count("*").alias("members")).orderBy("meta_type", "version")


def duplicate_types(objects: DataFrame) -> DataFrame:
    from ..functions.shapes import fold

    return objects.where("part = 0").groupBy(fold(F.col("meta_type")).alias("meta_type")).agg(F.count("*").alias("members")).where("members > 1").orderBy("meta_type")


def missing_types(objects: DataFrame) -> DataFrame:
    from ..functions.shapes import fold

    core = objects.sparkSession.createDataFrame([(t,) for t in CORE_TYPES], "meta_type string")
    return core.join(objects.where("part = 0").select(fold(F.col("meta_type")).alias("meta_type")), "meta_type", "left_anti").orderBy("meta_type")


def wrong_counts(objects: DataFrame) -> DataFrame:
    """Members whose meta.count is an integer other than the number of their objects."""
    declared = F.regexp_extract("declared", r"\Aint:(.*)\z", 1)
    return objects.where("part = 0").where(declared != "").where(declared != F.col("items").cast("string")).select("member", "meta_type", declared.alias("declared"), "items")


def as_json(summary_: dict) -> str:
    return json.dumps({"schema_version": 1, **summary_}, indent=2)


__all__ = ["audit", "summary", "top", "type_rows", "duplicate_types", "missing_types", "wrong_counts", "as_json", "tables"]
