"""Whole runs: anonymize, inspect, scrub, restore."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pseudonyms
from ..operators import audit, classify, decide, flatten, mapping, textops, verify
from ..sources import collection, publish
from . import tables
from .tables import Config


class LeakError(RuntimeError):
    """The gate found something; nothing was published. findings: all of it."""

    def __init__(self, message: str, findings: DataFrame | None = None):
        super().__init__(message)
        self.findings = findings


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="veilgraph-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def frozen(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and there for every later stage."""
    spark, path = df.sparkSession, f"{shared_root(df.sparkSession)}/veilgraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


class Run:
    """All tables of a run. Each is worked out when it is first asked for, and written if later ones read it again; an audit needs no replacement."""

    def __init__(self, members: DataFrame, salt: str, config: Config, reuse: dict | None, own_rules: list[tables.Rule] | None):
        self.members, self.salt, self.config, self.reuse = members, salt, config, reuse
        self.owned = {(c, pseudonyms.normalize(c, r)): p for c, m in (reuse or {}).get("categories", {}).items() for r, p in m.items()}
        self.keys = {r: p for (c, r), p in self.owned.items() if c == "opaque"}
        self.rules = own_rules or tables.rules(config)
        tables.check_rules(self.rules)
        self.known = tables.known_prefixes(self.rules)

    @cached_property
    def contexts(self) -> DataFrame:
        got = frozen(classify.contexts(flatten.objects(self.members)), "objects")
        refused = got.where(F.col("part") == flatten.REFUSED).select("member", "name").first()
        if refused:
            raise collection.CollectionError(f"{refused.member}: {refused.name}")
        return got

    @cached_property
    def leaves(self) -> DataFrame:
        return frozen(self._walked(), "leaves")

    def _walked(self) -> DataFrame:
        return flatten.leaves(self.contexts, self.known, self.salt, self.keys)

    @cached_property
    def resolved(self) -> DataFrame:
        return frozen(decide.resolve(self.leaves, self.config, self.rules), "resolved")

    @cached_property
    def evidence(self) -> decide.Evidence:
        got = decide.gather(self.contexts, self.resolved, self.config)
        return decide.Evidence(frozen(got.rids, "rids"), frozen(got.templates, "templates"))

    @cached_property
    def decided(self) -> DataFrame:
        return frozen(decide.decide(self.resolved, self.evidence), "decided")

    @cached_property
    def numbers(self) -> DataFrame:
        return decide.numbers(self.leaves, self.config, self.rules)

    @cached_property
    def values(self) -> DataFrame:
        return mapping.settled(mapping.distinct_values(self.decided), self.salt, self.owned, frozen)

    @cached_property
    def registry(self) -> DataFrame:
        found = mapping.identities(self.values).unionByName(mapping.key_identities(self.leaves, self.salt, self.keys))
        if self.reuse:
            saved = mapping.from_map(self.members.sparkSession, self.reuse)
            found = found.unionByName(saved.select("category", "real", "norm", "pseudonym", "pseudonym_norm"))
        return frozen(mapping.registry(found), "registry")

    @cached_property
    def records(self) -> DataFrame:
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("form", "token", "arg", "keep")]
        return frozen(self.decided.alias("d").join(self.values.alias("v"), same).select("d.*", "v.output"), "records")

    @cached_property
    def output(self) -> DataFrame:
        nodes = ["member", "part", "idx", "record", "ord", "steps", "kind"]
        out = (
            self.records.select(*nodes, F.col("output").alias("token")).unionByName(self.numbers.select(*nodes, F.col("out").alias("token")))
            .unionByName(self.leaves.where("kind in ('mapping', 'list')").select(*nodes, "token"))
        )
        return frozen(flatten.implode(out), "output")

    @cached_property
    def findings(self) -> DataFrame:
        """The output is read again, the source walked and decided again."""
        written = self.output.withColumn("key", F.when(F.col("part") == flatten.META, "meta").when(F.col("part") == flatten.REST, _root_key(F.col("record"))))
        context = self.contexts.select("member", "part", "idx", "node_type", "object_identifier", "privacy", "catalog_rule_id")
        again = flatten.leaves(written.drop("record").join(context, ["member", "part", "idx"]), {}, None)
        fresh = frozen(decide.decide(decide.resolve(self._walked(), self.config, self.rules), self.evidence), "decided")
        records = self.records.select("member", "record", "token", "output", *verify.JUDGED)
        gate = verify.findings(self.leaves, again, fresh, self.numbers, self.registry, records, self.salt, frozen)
        return frozen(gate.unionByName(verify.shape_findings(self.contexts)).unionByName(verify.evidence_findings(self.evidence, self.salt)), "findings")

    def documents(self) -> DataFrame:
        return flatten.documents(self.output)

    def audit(self) -> DataFrame:
        return audit.audit(self.contexts, self.decided, self.leaves, self.numbers)


def transform(members: DataFrame, salt: str, config: Config = Config(), reuse: dict | None = None, own_rules: list[tables.Rule] | None = None) -> Run:
    """Members (member, raw) to replaced documents with their evidence, mapping table and findings.

    Two passes, as evidence is collection-wide: decisions of all leaves come before any replacement. Distinct identities, and source against output, are
    the shuffles; rule and catalog tables are small and of fixed size, so they are broadcast.
    """
    return Run(members, salt, config, reuse, own_rules)


def _root_key(record):
    from ..functions import paths

    @F.pandas_udf("string")
    def run(records: pd.Series) -> pd.Series:
        return records.map(lambda p: paths.steps(p)[0], na_action="ignore")

    return run(record)


def policy(config: Config) -> dict:
    return {"profile": "core" if config.preserve_core else "none", "catalog_version": tables.CATALOG_VERSION, "preserve_microsoft_feature_defaults": config.preserve_feature, "preserve_third_party_defaults": config.preserve_third_party}


def anonymize(spark: SparkSession, source: str, out: str, mapping_path: str | None = None, reuse: str | None = None, salt: str | None = None, config: Config = Config()) -> dict:
    """Read a collection, replace it, verify it, and only then publish it and its mapping. Returns the audit."""
    publish.guard(source, out, mapping_path)
    saved = publish.load_mapping(reuse, tables.CATALOG_VERSION) if reuse else None
    salt = saved["salt"] if saved else salt or publish.new_salt()
    members = collection.read_members(spark, source)
    listed = collection.listing(spark, source)
    run = transform(members, salt, config, saved)
    if run.contexts.where("part = 0").isEmpty():
        raise collection.CollectionError("no member is a collection document")
    mapping.check_reuse(run.registry, saved or {})
    if saved:
        mapping.check_hierarchy(run.registry)
    before = mapping.fingerprint(run.registry)
    found = run.findings
    if not found.isEmpty():
        raise LeakError(f"verification failed: {[tuple(r) for r in verify.by_gate(found).limit(50).collect()]}", found)
    if mapping.fingerprint(run.registry) != before:
        raise LeakError("verification failed: registry-state-changed")
    parts = publish.mapping_parts(run.registry, salt, collection.source_hash(spark, source, run.members), policy(config), aliases=(saved or {}).get("legacy_reverse_aliases")) if mapping_path else None
    collection.check_unchanged(spark, source, listed)
    rows = collection.in_turn(run.documents(), "member", run.contexts.where("part = 0").count())  # at most MAX_MEMBERS files
    publish.publish(((r.member, r.body) for r in rows), out, (mapping_path, parts) if mapping_path else None)
    return audit.summary(run.audit())


def inspect(spark: SparkSession, source: str, config: Config = Config(), salt: str | None = None) -> dict:
    """The same plan without a sink: audit, findings and what is odd about the collection."""
    members = collection.read_members(spark, source)
    run = transform(members, salt or publish.new_salt(), config)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  small reports
    counts = frozen(run.audit(), "audit")
    return {
        "schema_version": 1, "members": members.count(), "accepted": run.contexts.where("part = 0").count(), "objects": run.contexts.where("part = 1").count(),
        "types": rows(audit.type_rows(run.contexts)), "duplicate_types": rows(audit.duplicate_types(run.contexts)), "missing_types": rows(audit.missing_types(run.contexts)),
        "wrong_counts": rows(audit.wrong_counts(run.contexts)), "identities": rows(mapping.category_counts(run.registry)), "audit": audit.summary(counts),
        "skipped": rows(audit.skipped(members, run.contexts)), "top_unknown_paths": rows(audit.top(counts).select("item", "n")),
        "more_unknown_paths": max(0, counts.where("section = 'unknown_paths'").count() - 20), "findings": rows(verify.by_gate(run.findings)),
    }


def scrub(spark: SparkSession, mapping_path: str, texts: DataFrame, col: str = "text") -> DataFrame:
    """texts with col replaced and a column report (counts by category, unresolved)."""
    own = textops.load(mapping.from_map(spark, publish.load_mapping(mapping_path)))
    got = texts.withColumn("_s", textops.scrub(F.col(col), own))
    return got.withColumn(col, F.col("_s.text")).withColumn("report", F.struct("_s.counts", "_s.unresolved")).drop("_s")


def restore(spark: SparkSession, mapping_path: str, texts: DataFrame, col: str = "text") -> DataFrame:
    own = textops.load(mapping.reversals(spark, publish.load_mapping(mapping_path)))
    return texts.withColumn(col, textops.restore(F.col(col), own))
