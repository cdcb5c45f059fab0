"""What becomes of each leaf: rule and catalog joins, then collection-wide evidence, then the form of its replacement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.shapes import dn_parses, domain_rid, fold, inner_sid, is_guid, is_oid, is_sid, spn_parses
from ..plans import tables
from ..plans.tables import Config

NAME_AT = ("properties.name", "properties.templatename")
FEW_RIDS, SALTS = 100_000, 16


@dataclass
class Evidence:
    """What the whole collection says: SIDs whose last arc stays everywhere, and the spelling of built-in templates."""

    rids: DataFrame  # sid, entry_id
    templates: DataFrame  # folded, source, entry_id


def secret(path: Column) -> Column:
    """The last step's name is one of the secret names."""
    leaf = F.regexp_replace(F.element_at(F.split(path, r"\."), -1), r"\[[0-9]+\]\z", "")
    return fold(leaf).isin(*tables.SECRETS)


def sentinel(token: Column, kind: Column) -> Column:
    """A number that says nothing: -1, or -2 where -1 would be the value itself; the type stays."""
    whole = F.when(token.try_cast("bigint").isNull(), F.raise_error(F.lit("a number to be redacted does not fit 64 bits"))).when(token.try_cast("bigint") == -1, "-2").otherwise("-1")
    return F.when(kind == "int", whole).otherwise(F.when(token.cast("double") == -1.0, "-2.0").otherwise("-1.0"))


def object_type(ref: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for t in tables.OBJECT_TYPES for x in (t.casefold(), t)])
    return pairs[fold(ref)]


def with_rules(leaves: DataFrame, own: list[tables.Rule]) -> DataFrame:
    """The rule for (node type, path), else the one for any type."""
    frame = tables.rules_frame(leaves.sparkSession, own)
    pack = F.struct("rule_id", "operation", "namespace", "allowed")
    typed = F.broadcast(frame.where("rule_type <> '*'").select(F.col("rule_type").alias("node_type"), F.col("rule_path").alias("canonical"), pack.alias("_typed")))
    star = F.broadcast(frame.where("rule_type = '*'").select(F.col("rule_path").alias("canonical"), pack.alias("_star")))
    return leaves.join(typed, ["node_type", "canonical"], "left").join(star, "canonical", "left").withColumn("rule", F.coalesce("_typed", "_star")).drop("_typed", "_star")


def _group(value: Column) -> Column:
    return F.when(is_sid(value), "SID").when(is_guid(value), "GUID").when(is_oid(value), "OID").otherwise("NAME")


def with_permits(rows: DataFrame, value: str, out: str, config: Config) -> DataFrame:
    """out: the catalog lets this value stay at this path, through the object's own entry or through the value's shape."""
    own = tables.permits_frame(rows.sparkSession, config)
    kinds = F.when(F.col("kind") == "WKGUID", "GUID").when(F.col("kind") == "TEMPLATE", "NAME").otherwise(F.col("kind"))
    context = F.broadcast(own.select(F.col("entry_id").alias("catalog_rule_id"), F.col("entry_type").alias("node_type"), F.col("entry_path").alias("canonical"), F.col("exact").alias("_f"), F.lit(True).alias("_a")).distinct())
    shape = F.broadcast(own.where(F.lower("value") == F.col("exact")).select(F.col("entry_type").alias("node_type"), F.col("entry_path").alias("canonical"), F.col("exact").alias("_f"), kinds.alias("_g"), F.lit(True).alias("_b")).distinct())
    got = rows.withColumn("_f", fold(F.col(value))).withColumn("_g", _group(F.col(value)))
    got = got.join(context, ["catalog_rule_id", "node_type", "canonical", "_f"], "left").join(shape, ["node_type", "canonical", "_f", "_g"], "left")
    return got.withColumn(out, F.coalesce("_a", "_b", F.lit(False))).drop("_a", "_b", "_f", "_g")


def with_kept_names(rows: DataFrame, config: Config, own: list[tables.Rule]) -> DataFrame:
    """rdn_keep: the names that stay within a distinguished name, as JSON, where the catalog keeps any at its path; only own rules lead there."""
    none, where = F.lit(None).cast("string"), {paths.canonical(r.path) for r in own if r.operation == "parse_dn"}
    frame = tables.permits_frame(rows.sparkSession, config).where(F.col("entry_path").isin(*where))
    if frame.isEmpty():
        return rows.withColumn("rdn_keep", none)
    named = lambda df, out, *keys: F.broadcast(df.groupBy(*keys, F.col("entry_type").alias("node_type"), F.col("entry_path").alias("canonical")).agg(F.collect_set("exact").alias(out)))
    got = rows.join(named(frame, "_a", F.col("entry_id").alias("catalog_rule_id")), ["catalog_rule_id", "node_type", "canonical"], "left")
    got = got.join(named(frame.where((F.lower("value") == F.col("exact")) & (F.col("kind") != "RID")), "_b"), ["node_type", "canonical"], "left")
    kept = F.array_sort(F.array_union(F.coalesce("_a", F.array().cast("array<string>")), F.coalesce("_b", F.array().cast("array<string>"))))
    return got.withColumn("rdn_keep", F.when((F.col("rule.operation") == "parse_dn") & (F.size(kept) > 0), F.to_json(kept))).drop("_a", "_b")


def with_rid_match(rows: DataFrame, config: Config) -> DataFrame:
    """rid_entry: the catalog entry that lets the SID's last arc stay here; a reference goes by the type its sibling names."""
    own = tables.permits_frame(rows.sparkSession, config).where("kind = 'RID'")
    reference = F.broadcast(own.select(F.col("entry_type").alias("_t"), F.col("entry_path").alias("canonical"), F.col("exact").alias("_rid"), F.col("entry_id").alias("_r")))
    definition = F.broadcast(own.select(F.col("entry_id").alias("catalog_rule_id"), F.col("entry_type").alias("node_type"), F.col("entry_path").alias("canonical"), F.col("exact").alias("_rid"), F.col("entry_id").alias("_d")))
    got = rows.withColumn("_rid", domain_rid(inner_sid(F.col("token")))).withColumn("_t", object_type(F.col("ref_type")))
    got = got.join(reference, ["_t", "canonical", "_rid"], "left").join(definition, ["catalog_rule_id", "node_type", "canonical", "_rid"], "left")
    hit = F.when(F.col("rule.operation") == "map_reference", F.col("_r")).when(F.col("rule.operation") == "map_custom_identifier", F.col("_d"))
    return got.withColumn("rid_entry", hit).drop("_r", "_d", "_rid", "_t")


def resolve(leaves: DataFrame, config: Config, own: list[tables.Rule] | None = None) -> DataFrame:
    """String leaves with operation, namespace, rule_id, audit_code, permitted, sub, sub_permitted, rid_entry."""
    v = F.col("token")
    rows = with_rules(leaves.where("kind = 'string'"), own or tables.rules(config))
    rows = rows.withColumn("sub", F.when(((F.col("canonical") == "properties.name") | (F.col("rule.operation") == "parse_composite")) & v.contains("@"), F.regexp_extract(v, r"(?s)\A(.*)@[^@]*\z", 1)))
    rows = with_permits(with_permits(rows, "token", "permitted", config), "sub", "sub_permitted", config)
    rows = with_kept_names(with_rid_match(rows, config), config, own or tables.rules(config))
    op, ns = F.col("rule.operation"), F.when(F.col("rid_entry").isNotNull(), "sids_preserve_rid").otherwise(F.col("rule.namespace"))
    actual = F.when(is_sid(v), "sids").when(is_guid(v), "guids").when(is_oid(v), "oids")
    declared_sid = ns.isin("sids", "sids_preserve_rid")
    routed = F.when((op == "map_reference") & ns.isin("sids", "sids_preserve_rid", "guids", "oids") & actual.isNotNull() & ~F.when(actual == "sids", declared_sid).otherwise(ns == actual), actual)
    at = F.length(v) - F.length(F.replace(v, F.lit("@"), F.lit("")))
    fits = (
        F.when(op == "parse_dn", dn_parses(v)).when(op == "parse_spn", spn_parses(v))
        .when((op == "parse_composite") & (at > 0), v.rlike(r"(?s)\A.+@[^@]+\z"))
        .when((op == "map_identity") & (at > 0), v.rlike(r"(?s)\A[^@]+@[^@]+\z"))
        .when((op == "map_identity") & ns.isin("domains", "hosts"), v.rlike(r"(?s)\A[^.]+(?:\.[^.]+)*\z"))
        .when(op.isin("map_custom_identifier", "map_reference") & declared_sid, is_sid(v)).otherwise(True)
    )
    schema_ok = F.coalesce(F.array_contains("rule.allowed", v), F.lit(False))
    pick = lambda o, n, code: F.struct(o.alias("operation"), n.alias("namespace"), code.alias("audit_code"))
    none, opaque = F.lit(None).cast("string"), F.lit("opaque")
    replace = F.lit("replace_opaque")
    unknown = (
        F.when(actual.isNotNull(), pick(F.lit("map_custom_identifier"), actual, F.concat(F.lit("unknown-"), F.regexp_replace(actual, "s$", ""), F.lit("-path"))))
        .otherwise(pick(replace, opaque, F.lit("unknown-string-path")))
    )
    ruled = (
        F.when((op == "preserve_schema_value") & schema_ok, pick(op, F.col("rule.namespace"), none))
        .when(op == "preserve_schema_value", pick(replace, opaque, F.lit("invalid-schema-string")))
        .when(F.col("permitted"), pick(F.lit("preserve_constant"), none, none))
        .when(routed.isNotNull(), pick(op, routed, none))
        .when(~fits, pick(replace, opaque, F.lit("malformed-source-value")))
        .otherwise(pick(op, ns, none))
    )
    fallback = F.concat(F.lit("fallback."), F.coalesce(F.regexp_replace(actual, "s$", ""), F.lit("unknown-string")))
    got = rows.withColumn("d", F.when(op.isNotNull(), ruled).otherwise(unknown)).withColumn("rule_id", F.coalesce("rule.rule_id", fallback))
    return got.select(*leaves.columns, "d.*", "rule_id", "permitted", "sub", "sub_permitted", "rid_entry", "rdn_keep")


def template_candidate(rows: DataFrame) -> DataFrame:
    """identity, and candidate: this leaf names the built-in template that its object is."""
    spark = rows.sparkSession
    own = F.broadcast(tables.catalog_frame(spark).where("kind = 'TEMPLATE'").select(F.col("entry_id").alias("catalog_rule_id"), F.col("entry_type").alias("node_type"), F.col("value").alias("_f"), F.lit(True).alias("candidate")))
    identity = F.when((F.col("node_type") == "CertTemplate") & F.col("canonical").isin(*NAME_AT), F.when(F.col("canonical") == NAME_AT[0], F.coalesce("sub", "token")).otherwise(F.col("token")))
    return rows.withColumn("identity", identity).withColumn("_f", fold(F.col("identity"))).join(own, ["catalog_rule_id", "node_type", "_f"], "left").drop("_f").withColumn("candidate", F.coalesce("candidate", F.lit(False)))


def gather(contexts: DataFrame, resolved: DataFrame, config: Config) -> Evidence:
    """Evidence does not depend on the order of members: definitions come before references, then the least entry."""
    spark = resolved.sparkSession
    entries = F.broadcast(tables.catalog_frame(spark).where(f"kind = 'RID' and entry_privacy = '{tables.CORE}'").select(F.col("entry_id").alias("catalog_rule_id"), F.col("entry_type").alias("node_type"), F.col("value").alias("_rid")))
    inner = inner_sid(F.col("object_identifier"))
    defined = contexts.withColumn("_rid", domain_rid(inner)).join(entries, ["catalog_rule_id", "node_type", "_rid"]).select(F.upper(inner).alias("sid"), F.lit(0).alias("rank"), F.col("catalog_rule_id").alias("entry_id"))
    named = resolved.where("rid_entry is not null and operation in ('map_custom_identifier', 'map_reference')").select(F.upper(inner_sid(F.col("token"))).alias("sid"), F.lit(1).alias("rank"), F.col("rid_entry").alias("entry_id"))
    rids = defined.union(named).groupBy("sid").agg(F.min(F.struct("rank", "entry_id")).alias("b")).select("sid", "b.entry_id")
    known = template_candidate(resolved).where("candidate and (operation = 'preserve_constant' or sub_permitted)")
    order = F.struct(F.when(F.col("canonical") == NAME_AT[1], 0).otherwise(1), "identity")
    templates = known.groupBy(fold(F.col("identity")).alias("folded")).agg(F.min_by("identity", order).alias("source"), F.min("catalog_rule_id").alias("entry_id"))
    return Evidence(rids, templates)


def with_evidence(rows: DataFrame, rids: DataFrame) -> DataFrame:
    """_rid: the entry that the value's SID is evidence of. Evidence of up to FEW_RIDS rows is broadcast; more of it is joined with each SID in SALTS copies, as
    a domain's groups stand at a large share of all leaves, and leaves without a SID are spread."""
    sid, entry = F.upper(inner_sid(F.col("token"))), F.col("entry_id").alias("_rid")
    if rids.count() <= FEW_RIDS:
        return rows.withColumn("_sid", sid).join(F.broadcast(rids.select(F.col("sid").alias("_sid"), entry)), "_sid", "left").drop("_sid")
    at = F.xxhash64("member", "record")
    key = F.when(sid.rlike(r"\AS-1-"), sid).otherwise(F.concat(F.lit("#"), F.pmod(at, F.lit(4096)).cast("string")))
    salted = rids.select(F.col("sid").alias("_sid"), entry, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_sid", key).withColumn("_salt", F.pmod(at, F.lit(SALTS)).cast("int")).join(salted, ["_sid", "_salt"], "left").drop("_sid", "_salt")


def decide(resolved: DataFrame, evidence: Evidence) -> DataFrame:
    """resolved with evidence applied, and form, arg, keep: how the value is replaced."""
    v, op, ns = F.col("token"), F.col("operation"), F.col("namespace")
    rows = with_evidence(template_candidate(resolved), evidence.rids)
    targets = F.broadcast(evidence.templates)  # at most one row for each built-in template
    rows = rows.withColumn("_k", fold(F.coalesce("identity", "token"))).join(targets.select(F.col("folded").alias("_k"), "source", F.col("entry_id").alias("_target")), "_k", "left").drop("_k")
    replay = F.col("_rid").isNotNull() & op.isin("map_custom_identifier", "map_reference") & ns.isin("sids", "identifiers", "sids_preserve_rid")
    template = (F.col("candidate") | ((op == "map_reference") & (ns == "cert_templates"))) & F.col("source").isNotNull()
    demoted = (op == "preserve_constant") & ~template & (F.col("node_type") == "CertTemplate") & F.col("canonical").isin(*NAME_AT)
    rows = rows.withColumn("evidence", F.when(template, F.concat(F.lit("discovered-template-target:"), "_target")).when(replay, F.concat(F.lit("discovered-domain-rid-target:"), "_rid")))
    rows = rows.withColumn("namespace", F.when(demoted, "cert_templates").when(replay, "sids_preserve_rid").otherwise(ns)).withColumn("operation", F.when(demoted, "map_identity").otherwise(op)).withColumn("_t", template)
    named = (op == "map_identity") & (F.col("canonical") == "properties.name") & v.contains("@")
    template_form = F.when(F.col("source").isNotNull(), "literal").otherwise("cert_templates")
    by_space = (
        F.when(ns == "cert_templates", template_form).when(ns == "sids_preserve_rid", "sid").when(ns == "sids", "sid").when(ns == "guids", "guid").when(ns == "oids", "oids")
        .when(ns == "domains", "domain").when(ns == "hosts", "host").when(ns == "identifiers", "shape").otherwise("token")
    )
    account = F.when(F.col("canonical") == "properties.samaccountname", "machine").when((F.col("canonical") == "properties.userprincipalname") | (F.col("canonical").isin("properties.email", "properties.mail") & v.contains("@")), "address").otherwise("token")
    form = (
        F.when((v != "") & secret(F.col("path")), "redacted")
        .when((op == "preserve_constant") & F.col("_t"), "literal").when(op.isin("preserve_constant", "preserve_schema_value"), "same")
        .when(named & (ns == "cert_templates"), "template_at").when(named, "name_at").when((op == "map_identity") & (ns == "accounts"), account)
        .when(op.isin("map_identity", "map_reference"), by_space).when(op == "map_custom_identifier", "shape").when(op == "parse_dn", "dn").when(op == "parse_spn", "spn")
        .when(op == "parse_composite", "group_at").when(v == "", "same").otherwise("opaque")
    )
    rows = rows.withColumn("form", form).withColumn("arg", F.when(F.col("form") == "literal", F.col("source")).when(F.col("form") == "dn", F.col("rdn_keep")).when(F.col("form") == "template_at", F.coalesce("source", F.when(F.col("candidate"), F.col("identity")))))
    keep = F.when(F.col("form").isin("sid", "shape"), ns == "sids_preserve_rid").when(F.col("form").isin("name_at", "group_at"), F.coalesce("sub_permitted", F.lit(False))).otherwise(False)
    return rows.withColumn("keep", F.coalesce(keep, F.lit(False))).drop("_t", "_rid", "_target", "source", "candidate", "identity", "rdn_keep")


def numbers(leaves: DataFrame, config: Config, own: list[tables.Rule] | None = None) -> DataFrame:
    """Leaves that are neither string nor container, with out and undeclared."""
    rows = with_rules(leaves.where("kind in ('int', 'float', 'bool', 'null')"), own or tables.rules(config))
    numeric = F.col("kind").isin("int", "float")
    undeclared = numeric & F.col("rule").isNull() & (F.col("canonical") != "properties.functionallevel")
    redact = (numeric & (F.col("canonical") == "properties.functionallevel")) | (undeclared & F.lit(config.redact_undeclared_numbers))
    return rows.select(*leaves.columns, F.when(redact, sentinel(F.col("token"), F.col("kind"))).otherwise(F.col("token")).alias("out"), undeclared.alias("undeclared"))
