"""The gate: what was written is held against what the source should become, derived anew. Any row stops publication.

Decisions are resolved again from the source; expected values are put together from the mapping table by joins, not by the
function that made the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pseudonyms, shapes
from ..plans import tables
from . import mapping

FINDING = ("gate", "member", "path", "code", "offender")


def shape_findings(objects: DataFrame) -> DataFrame:
    """meta.count must be an integer equal to the number of objects."""
    meta = objects.where("part = 0")
    bad = meta.where(F.coalesce(F.col("declared") != F.concat(F.lit("int:"), F.col("items").cast("string")), F.lit(True)))
    return bad.select(F.lit("source").alias("gate"), "member", F.lit("meta.count").alias("path"), F.lit("source-invalid-meta-count").alias("code"), F.lit(None).cast("string").alias("offender"))


def expected(decided: DataFrame, registry: DataFrame) -> DataFrame:
    """(form, token, arg, keep, expected, missing): values from their pieces' rows in the mapping table."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for form, token, arg, keep in b[["form", "token", "arg", "keep"]].itertuples(index=False):
                own = mapping.whole(mapping.cut(form, token, arg if isinstance(arg, str) else None, bool(keep)))
                rows.append((form, token, arg, keep, [{"category": c, "text": t, "norm": c and pseudonyms.normalize(c, t)} for c, t in own]))
            yield pd.DataFrame(rows, columns=["form", "token", "arg", "keep", "pieces"])

    values = mapping.distinct_values(decided).mapInPandas(cut, mapping.CUT).withColumn("v", F.xxhash64("form", "token", "arg", "keep"))
    each = values.select("form", "token", "arg", "keep", "v", F.posexplode("pieces").alias("k", "p")).select("form", "token", "arg", "keep", "v", "k", "p.*")
    got = each.join(registry.select("category", "norm", "pseudonym"), ["category", "norm"], "left")
    text = F.when(F.col("category").isNull(), F.col("text")).otherwise(F.col("pseudonym"))
    return got.groupBy("form", "token", "arg", "keep").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x.t), "").alias("expected"),
        F.max(F.col("category").isNotNull() & F.col("pseudonym").isNull()).alias("missing"),
    )


def output_shape_fits(operation, namespace, form, value, out):
    """What is written looks like what its operation makes of such a value."""
    identifier, at = operation.isin("map_custom_identifier", "map_reference"), value.contains("@")
    return (
        F.when(form == "redacted", out == pseudonyms.REDACTED)
        .when(identifier & shapes.whole(value, shapes.SID_ANY), shapes.whole(out, shapes.SID_ANY))
        .when(identifier & shapes.is_guid(value), shapes.is_guid(out)).when(identifier & shapes.is_oid(value), shapes.is_oid(out))
        .when((operation == "map_identity") & at, out.rlike(r"(?s)\A[^@]+@[^@]+\z"))
        .when((operation == "map_identity") & namespace.isin("domains", "hosts") & (value != ""), out.rlike(r"(?s)\A[^.]+(?:\.[^.]+)*\z"))
        .when((operation == "parse_dn") & (value != ""), shapes.dn_parses(out)).when((operation == "parse_spn") & (value != ""), shapes.spn_parses(out))
        .when((operation == "parse_composite") & at, out.rlike(r"(?s)\A.+@[^@]+\z"))
        .when((operation == "replace_opaque") & (value != ""), shapes.whole(out, shapes.REDACTED)).otherwise(True)
    )


def _mark(salt: str):
    """Offending values as keyed digests."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: pseudonyms.finding_mark(salt, v) if v else v, na_action="ignore")

    return run


def evidence_findings(evidence, salt: str) -> DataFrame:
    """Evidence that the catalog doesn't bear out: a SID whose last arc isn't its entry's, a template that isn't its entry's."""
    spark, mark = evidence.rids.sparkSession, _mark(salt)
    catalog = tables.catalog_frame(spark)
    rid = catalog.where(f"kind = 'RID' and entry_privacy = '{tables.CORE}'").select("entry_id", F.col("value").alias("_v"), F.lit(True).alias("_ok"))
    template = catalog.where("kind = 'TEMPLATE' and entry_type = 'CertTemplate'").select("entry_id", F.col("value").alias("_v"), F.lit(True).alias("_ok"))
    rids = evidence.rids.select(F.col("sid").alias("key"), F.col("sid").alias("value"), "entry_id", shapes.domain_rid(F.col("sid")).alias("_v"), (F.col("sid") == F.upper("sid")).alias("fits"))
    named = evidence.templates.select(F.col("folded").alias("key"), F.col("source").alias("value"), "entry_id", F.col("folded").alias("_v"), (F.col("folded") == shapes.fold(F.col("source"))).alias("fits"))
    held = rids.join(F.broadcast(rid.distinct()), ["entry_id", "_v"], "left").unionByName(named.join(F.broadcast(template.distinct()), ["entry_id", "_v"], "left"))
    bad = held.where(~(F.coalesce("_ok", F.lit(False)) & F.coalesce("fits", F.lit(False))))
    return bad.select(F.lit("evidence").alias("gate"), F.lit(None).cast("string").alias("member"), F.concat(F.lit("target["), mark("key"), F.lit("]")).alias("path"), F.lit("invalid-target-evidence").alias("code"), mark("value").alias("offender"))


#: What a written record says of its leaf's context and decision, where it says so.
JUDGED = ("node_type", "object_identifier", "privacy", "catalog_rule_id", "operation", "namespace", "rule_id", "audit_code", "evidence")


def record_findings(strings: DataFrame, records: DataFrame, salt: str) -> DataFrame:
    """strings: member, record, a (source), b (output) of each string leaf, and judged: its context and decision; records: member, record, token, output, judged of
    each that was written. One finding for each string whose record is missing, doubled or says something else, and for each record too many."""
    mark = _mark(salt)
    row = lambda df, what: df.select(F.lit("records").alias("gate"), "member", F.col("record").alias("path"), what.alias("code"), "offender")
    counted = records.groupBy("member", "record").agg(F.count("*").alias("n"), F.first("token").alias("r_token"), F.first("output").alias("r_out"), F.first("judged").alias("r_judged"))
    both = strings.select("member", "record", "a", "b", "judged", F.lit(True).alias("own")).join(counted, ["member", "record"], "full_outer")
    same = F.col("r_token").eqNullSafe(F.col("a")) & F.col("r_out").eqNullSafe(F.col("b")) & F.col("r_judged").eqNullSafe(F.col("judged"))
    which = F.when(F.col("own").isNull(), "record-extra").when(F.col("n").isNull(), "record-missing").when(F.col("n") > 1, "record-duplicate").when(~same, "policy-record-mismatch")
    return row(both.withColumn("code", which).where("code is not null").withColumn("offender", mark(F.coalesce("a", "r_token"))), F.col("code"))


def findings(source: DataFrame, output: DataFrame, decided: DataFrame, numbers: DataFrame, registry: DataFrame, records: DataFrame, salt: str, freeze=lambda df, tag: df) -> DataFrame:
    """Rows (gate, member, path, code, offender); empty if all is well.

    source and output: nodes (member, record, kind, token); decided, numbers: the source's leaves resolved anew; records: (member, record, token, output, and of JUDGED
    what they say), one for each string leaf that was written. freeze: writes a table that several gates read.
    """
    judged = [c for c in JUDGED if c in records.columns]
    pack = F.struct(F.lit(0).alias("_"), *judged)
    same = ["form", "token", "arg", "keep"]
    want = decided.withColumn("judged", pack).alias("d").join(expected(decided, registry).alias("e"), [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in same])
    want = want.select("d.member", "d.record", "d.operation", "d.namespace", "d.form", "d.judged", F.col("e.expected").alias("want"), "e.missing")
    want = want.unionByName(numbers.select("member", "record", F.col("out").alias("want")), allowMissingColumns=True)
    left = source.where("kind not in ('key', 'collision')").select("member", "record", F.col("kind").alias("kind_a"), F.col("token").alias("a"))
    right = output.where("kind not in ('key', 'collision')").select("member", "record", F.col("kind").alias("kind_b"), F.col("token").alias("b"))
    both = freeze(left.join(right, ["member", "record"], "full_outer").join(want, ["member", "record"], "left"), "compared")
    container = F.col("kind_a").isin("mapping", "list")
    text = F.col("kind_a") == "string"
    other = ~F.col("b").eqNullSafe(F.col("want"))
    code = (
        F.when(F.col("kind_a").isNull() | F.col("kind_b").isNull(), "source-output-topology-mismatch").when(F.col("kind_a") != F.col("kind_b"), "value-type-mismatch")
        .when(container & ~F.col("a").eqNullSafe(F.col("b")), "source-output-topology-mismatch").when(text & F.col("missing"), "registry-mapping-missing")
        .when(text & other & (F.col("operation") == "map_reference"), "reference-mapping-mismatch").when(text & other & (F.col("b") == F.col("a")), "identity-not-transformed")
        .when(text & other, "mapped-value-mismatch")
        .when(text & ~output_shape_fits(F.col("operation"), F.col("namespace"), F.col("form"), F.col("a"), F.col("b")), "output-shape-mismatch")
        .when(~text & ~container & other & ~F.col("want").eqNullSafe(F.col("a")), "undeclared-numeric-not-redacted").when(~text & ~container & other, "schema-value-mismatch")
    )
    row = lambda df, gate, what: df.select(F.lit(gate).alias("gate"), "member", F.col("record").alias("path"), what.alias("code"), "offender")
    values = row(both.withColumn("code", code).where("code is not null").withColumn("offender", _mark(salt)(F.coalesce("a", "b"))), "output", F.col("code"))
    written = records.select("member", "record", "token", "output", pack.alias("judged"))
    records_ = record_findings(both.where("kind_a = 'string'"), written, salt)
    clash = row(source.where("kind = 'collision'").withColumn("offender", F.lit(None).cast("string")), "source", F.lit("output-key-collision"))
    unsafe = mapping.problems(registry).select(F.lit("registry").alias("gate"), F.lit(None).cast("string").alias("member"), F.col("category").alias("path"), F.lit("unsafe-registry").alias("code"), F.col("problem").alias("offender"))
    return values.unionByName(records_).unionByName(clash).unionByName(unsafe)


#: The gates in the order in which a run meets them.
GATES = ("source", "evidence", "registry", "output", "records")


def by_gate(found: DataFrame) -> DataFrame:
    """Findings counted by gate and code, gates in their order, with the first member and path of each."""
    first = F.min(F.struct("member", "path"))
    rank = F.array_position(F.array(*map(F.lit, GATES)), F.col("gate"))
    got = found.groupBy("gate", "code").agg(F.count("*").alias("n"), first.alias("f")).orderBy(rank, "code")
    return got.select("gate", "code", "n", F.col("f.path").alias("first_path"))
