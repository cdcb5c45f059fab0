"""Registered queries on sources, sinks, mapping files, evidence of templates, and whole published runs."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from .catalogue import SALT, _people, query
from .functions import pseudonyms, shapes
from .operators import audit, classify, decide, flatten, mapping, textops
from .plans import adapter, job, tables
from .plans.adapter import table
from .plans.tables import Config
from .sources import collection, publish

MEMBERS_SQL = """SELECT 'users' AS meta_type, c_nationkey AS k, count(*) AS objects FROM customer GROUP BY c_nationkey, c_custkey // 100000
UNION ALL SELECT 'computers', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey, s_suppkey // 100000 UNION ALL SELECT 'domains', 0, count(*) FROM nation"""
# Distinguished names and whether all their attribute types are standard ones; numbers in dots and their one form.
NAMES = (("CN=a,DC=b", True), ("cn=a+OU=b,dc=c", True), ("X=a,DC=b", False), (r"CN=a\,X=b,DC=c", True), ("CN=a,DC=", False), ("uid=1,st=x,street=y,l=z,o=p,c=q", True), ("", False), ("DC=a,b", False))
DOTTED = (("1.2.3.4", "1.2.3.4"), ("01.002.3", "1.2.3"), ("0.0.00", "0.0.0"), ("1.a.2", "1.a.2"), ("1", "1"), ("1..2", "1..2"))
MASKS = (("[REDACTED]", True), ("[REDACTED:abc234]", True), ("[REDACTED:ABC]", False), ("[REDACTED:]", False), ("x[REDACTED]", False), ("[REDACTED:a1]", False))
# Identifiers, whether they are SIDs, SIDs behind any prefix, the SID behind the prefix, and the last arc below a domain.
SIDS = (
    ("S-1-5-11", True, True, "S-1-5-11", None), ("CORP.LOCAL-S-1-5-32-544", False, True, "S-1-5-32-544", None), ("s-1-5-21-1-2-3-512", True, True, "s-1-5-21-1-2-3-512", "512"), ("S-1-5-21-1-2-3", True, True, "S-1-5-21-1-2-3", None),
    ("CORP-S-1-5-21-1-2-3-513", False, True, "S-1-5-21-1-2-3-513", "513"), ("S-1-5", False, False, "S-1-5", None), ("words", False, False, "words", None),
)
# Built-in identifiers and what the catalog says of them - privacy of a SID, built-in RID, well-known GUID, built-in name.
BUILT_IN = (("S-1-5-11", "core_global_default", False, False, False), ("S-1-5-21-1-2-3-512", "custom", False, False, False), ("S-1-9-9", "unknown", False, False, False), ("512", "unknown", True, False, False), ("1105", "unknown", False, False, False),
            ("31B2F340-016D-11D2-945F-00C04FB984F9", "unknown", False, True, False), ("domain users", "unknown", False, False, True), ("Web Server", "unknown", False, False, True))


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def _picked(cases, k: int) -> str:
    """SQL for the k-th value of the case that a part is dealt."""
    return f"CASE p_partkey % {len(cases)} " + " ".join(f"WHEN {n} THEN {_sql(c[k])}" for n, c in enumerate(cases)) + " END"


def _folder(spark, name: str) -> str:
    """A new place in the shared folder, for sinks that write where the driver sees it."""
    root = f"{job.shared_root(spark).removeprefix('file://')}/veilgraph/runs"
    os.makedirs(root, exist_ok=True)
    return f"{root}/{uuid.uuid4().hex}-{name}"


def _published(spark, sf_dir, name: str):
    """The adapter's members, at most MAX_MEMBERS of bounded size, written by a sink and read back by the source."""
    at = _folder(spark, name)
    rows = adapter.members(spark, sf_dir).orderBy("member").toLocalIterator()
    publish.publish(((f"{r.member}.json", bytes(r.raw).decode()) for r in rows), at, None)
    return collection.read_members(spark, at)


def _counted(members):
    own = flatten.objects(members)
    sizes = own.where("part = 1").groupBy("member").agg(F.count("*").alias("objects"), F.min("object_identifier").alias("o"))
    kinds = own.where("part = 0").select("member", "meta_type")
    nation = F.regexp_extract("o", r"S-1-5-21-([0-9]+)-", 1).cast("long") - 1000000
    return kinds.join(sizes, "member").select("meta_type", F.when(F.col("meta_type") == "domains", 0).otherwise(nation).cast("int").alias("k"), "objects")


@query(MEMBERS_SQL)
def directory_roundtrip(spark, sf_dir):
    """Members published as a folder, read back and parsed."""
    return _counted(_published(spark, sf_dir, "out"))


@query(MEMBERS_SQL)
def archive_roundtrip(spark, sf_dir):
    """Members published as an archive, its directory read, its members inflated and parsed."""
    return _counted(_published(spark, sf_dir, "out.zip"))


@query("SELECT 'accounts' AS category, c_name AS real, lower(c_name) AS norm, TRUE AS same FROM customer")
def mapping_file_roundtrip(spark, sf_dir):
    """A mapping table written as a file and loaded: same rows, same pseudonyms."""
    reg, at = mapping.registry(mapping.identities(_people(spark, sf_dir))), _folder(spark, "map.json")
    publish._private(at, publish.mapping_text(reg, SALT, "", job.policy(Config())).encode())
    back = mapping.from_map(spark, publish.load_mapping(at, tables.CATALOG_VERSION))
    got = reg.join(back.select("category", "norm", F.col("pseudonym").alias("p"), F.col("pseudonym_norm").alias("q"), F.col("real").alias("r")), ["category", "norm"], "full_outer")
    return got.select("category", "real", "norm", (F.col("pseudonym").eqNullSafe(F.col("p")) & F.col("pseudonym_norm").eqNullSafe(F.col("q")) & F.col("real").eqNullSafe(F.col("r"))).alias("same"))


@query("SELECT c_custkey, c_name AS real, TRUE AS found FROM customer")
def lookup_reverse(spark, sf_dir):
    """Each customer by its pseudonym, in capitals."""
    done = _people(spark, sf_dir)
    reg = mapping.registry(mapping.identities(done))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("token")).join(done.select("token", F.upper("output").alias("pseudonym")), "token")
    got = mapping.reverse(reg, asked.select("pseudonym").distinct()).where("category = 'accounts'")
    return asked.join(got, F.col("pseudonym") == F.col("asked")).select("c_custkey", "real", (F.col("real") == F.col("token")).alias("found"))


@query("SELECT real FROM (SELECT c_name AS real FROM customer UNION SELECT 'S-1-5-21-1-2-3-' || n_nationkey || '-7' FROM nation)")
def real_token_listing(spark, sf_dir):
    reals = {f"S-1-5-21-4-5-6-{r.n_nationkey}": f"S-1-5-21-1-2-3-{r.n_nationkey}-7" for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()}  # nations are a fixed table
    return mapping.real_tokens(mapping.registry(mapping.identities(_people(spark, sf_dir))), {"legacy_reverse_aliases": reals})


@query("""SELECT c_nationkey, 'S-1-5-21-' || c_nationkey || '-2-3-' || c_custkey AS real, 'S-1-5-21-7-8-' || (c_nationkey + 9) || '-' || (c_custkey + 5) AS fake, FALSE AS alias FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_nationkey, 'S-1-5-21-' || c_nationkey || '-2-3-' || c_custkey || '-1', 'S-1-5-21-7-8-' || (c_nationkey + 9) || '-' || (c_custkey + 5), TRUE FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT c_nationkey, 'S-1-5-21-' || c_nationkey || '-2-3', 'S-1-5-21-7-8-' || (c_nationkey + 9), FALSE FROM customer GROUP BY ALL""")
def legacy_mapping_upgrade(spark, sf_dir):
    """SIDs of a mapping of format 1, a nation at a time: those one arc below the domain become SIDs of format 2, those further below aliases."""
    n, c = F.col("c_nationkey"), F.col("c_custkey")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        nation = int(own.c_nationkey.iloc[0])
        sids = {f"{nation}-2-3": f"S-1-5-21-7-8-{nation + 9}"} | dict(zip(own.real, own.fake))
        got, aliases = publish.upgrade_sids(sids)
        return pd.DataFrame([(nation, r, p, False) for r, p in got.items()] + [(nation, r, p, True) for p, r in aliases.items()], columns=["c_nationkey", "real", "fake", "alias"])

    real = F.concat(F.lit("S-1-5-21-"), n.cast("string"), F.lit("-2-3-"), c.cast("string"), F.when(c % 2 == 1, "-1").otherwise(""))
    fake = F.concat(F.lit("S-1-5-21-1-1-"), (c + 5).cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", real.alias("real"), fake.alias("fake"))
    return rows.groupBy("c_nationkey").applyInPandas(run, "c_nationkey int, real string, fake string, alias boolean")


@query(f"SELECT p_partkey, {_picked(SIDS, 1)} AS is_sid, {_picked(SIDS, 2)} AS prefixed, {_picked(SIDS, 3)} AS inner_sid, {_picked(SIDS, 4)} AS rid FROM part")
def sid_predicates(spark, sf_dir):
    v = F.col("v")
    rid = shapes.domain_rid(shapes.inner_sid(v))
    return _dealt_at(spark, sf_dir, SIDS).select("p_partkey", shapes.is_sid(v).alias("is_sid"), shapes.whole(v, shapes.SID_ANY).alias("prefixed"), shapes.inner_sid(v).alias("inner_sid"), rid.alias("rid"))


def _dealt_at(spark, sf_dir, cases):
    """p_partkey with the first value of the case that it is dealt."""
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(c[0]) for c in cases]), (F.col("p_partkey") % len(cases) + 1).cast("int")).alias("v"))


@query(f"SELECT p_partkey, {_picked(NAMES, 1)} AS parses FROM part")
def dn_attribute_types(spark, sf_dir):
    return _dealt_at(spark, sf_dir, NAMES).select("p_partkey", shapes.dn_parses(F.col("v")).alias("parses"))


@query(f"SELECT p_partkey, {_picked(MASKS, 1)} AS masked FROM part")
def redacted_shape(spark, sf_dir):
    return _dealt_at(spark, sf_dir, MASKS).select("p_partkey", F.col("v").rlike(rf"\A{shapes.REDACTED}\z").alias("masked"))


@query(f"SELECT p_partkey, {_picked(DOTTED, 1)} AS norm, {_picked(DOTTED, 1)} AS joined FROM part")
def dotted_numbers(spark, sf_dir):
    """The identity of an object identifier, by the function and by the column that lookups use."""

    @F.pandas_udf("string")
    def norm(values: pd.Series) -> pd.Series:
        return values.map(lambda v: pseudonyms.normalize("oids", v))

    return _dealt_at(spark, sf_dir, DOTTED).select("p_partkey", norm("v").alias("norm"), mapping._norm("oids", "v").alias("joined"))


@query(f"SELECT p_partkey, {_picked(BUILT_IN, 1)} AS privacy, {_picked(BUILT_IN, 2)} AS rid, {_picked(BUILT_IN, 3)} AS guid, {_picked(BUILT_IN, 4)} AS named FROM part")
def catalog_predicates(spark, sf_dir):
    v = F.col("v")
    return _dealt_at(spark, sf_dir, BUILT_IN).select("p_partkey", classify.sid_privacy(v).alias("privacy"), classify.is_builtin_rid(v).alias("rid"), classify.is_wellknown_guid(v).alias("guid"), classify.is_builtin_name(v).alias("named"))


def _leaf(rows, **own):
    """rows as string leaves; columns that aren't given are null."""
    none = F.lit(None).cast("string")
    return rows.select(*rows.columns, F.lit("string").alias("kind"), *[own.get(c, none).alias(c) for c in ("node_type", "canonical", "path", "token", "ref_type", "catalog_rule_id")])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'rid.domain-users' END AS rid_entry, CASE WHEN c_custkey % 3 = 0 THEN 'sids_preserve_rid' ELSE 'identifiers' END AS namespace FROM customer""")
def rid_references(spark, sf_dir):
    """References to a domain's group 513: only where the sibling says it is a group does its last arc stay."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    token = F.concat(adapter.domain_sid(n), F.lit("-513"))
    leaves = _leaf(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), node_type=F.lit("Group"), canonical=F.lit("members[].objectidentifier"), path=F.lit("Members[0].ObjectIdentifier"), token=token,
                   ref_type=F.when(c % 3 == 0, "GROUP").when(c % 3 == 1, "User"))
    return decide.resolve(leaves, Config()).select("c_custkey", "rid_entry", "namespace")


@query("""SELECT c_custkey, c_custkey % 4 = 0 AS permitted, c_custkey % 4 = 0 AS core, FALSE AS none FROM customer""")
def catalog_permits(spark, sf_dir):
    """A built-in template's name stays on the object of that template, under a profile that keeps it."""
    c = F.col("c_custkey")
    entry = {e.value: e.rule_id for e in tables.catalog() if e.kind == "TEMPLATE"}["web server"]
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    leaves = _leaf(rows, node_type=F.when(c % 4 == 1, "User").otherwise("CertTemplate"), canonical=F.when(c % 4 == 2, "properties.description").otherwise("properties.templatename"), path=F.lit("Properties.templatename"),
                   token=F.when(c % 4 == 3, "My Server").otherwise("WEB Server"), catalog_rule_id=F.lit(entry))
    kept = lambda config, out: decide.with_permits(leaves, "token", out, config).select("c_custkey", out)
    core, off = kept(Config(), "core"), kept(Config(preserve_core=False), "none")
    return kept(Config(), "permitted").join(core, "c_custkey").join(off, "c_custkey")


@query("SELECT 'web server' AS folded, 'WEB Server' AS source FROM customer LIMIT 1")
def template_election(spark, sf_dir):
    """Three spellings of one built-in template on many objects: that of templatename comes before that of name, then the least."""
    c = F.col("c_custkey")
    entry = {e.value: e.rule_id for e in tables.catalog() if e.kind == "TEMPLATE"}["web server"]
    leaves = _leaf(table(spark, sf_dir, "customer").select("c_custkey"), node_type=F.lit("CertTemplate"), canonical=F.when(c % 3 == 0, "properties.name").otherwise("properties.templatename"), path=F.lit("Properties.x"),
                   token=F.when(c % 3 == 0, "WEB SERVER@CORP.LOCAL").when(c % 3 == 1, "WEB Server").otherwise("Web Server"), catalog_rule_id=F.lit(entry))
    none = F.lit(None).cast("string")
    empty = leaves.select(none.alias("object_identifier"), "catalog_rule_id", "node_type")
    return decide.gather(empty, decide.resolve(leaves, Config()), Config()).templates.select("folded", "source")


@query("""SELECT kind, undeclared, out, count(*) AS n FROM (SELECT 'int' AS kind, TRUE AS undeclared, CASE WHEN c_nationkey - 1 = -1 THEN '-2' ELSE '-1' END AS out FROM customer
UNION ALL SELECT 'int', TRUE, CAST(c_nationkey - 1 AS VARCHAR) FROM customer UNION ALL SELECT 'bool', FALSE, 'true' FROM customer UNION ALL SELECT 'bool', FALSE, 'true' FROM customer) GROUP BY ALL""")
def number_toggle(spark, sf_dir):
    """Undeclared numbers, redacted and kept; flags stay either way."""
    none = F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer").select(F.lit("User").alias("node_type"), F.lit("properties.zq").alias("canonical"), F.explode(F.array(F.struct(F.lit("int").alias("kind"), (F.col("c_nationkey") - 1).cast("string").alias("token")), F.struct(F.lit("bool").alias("kind"), F.lit("true").alias("token")))).alias("x")).select("node_type", "canonical", "x.*")
    own = decide.numbers(c, Config()).unionByName(decide.numbers(c, Config(redact_undeclared_numbers=False)))
    return own.groupBy("kind", "undeclared", "out").agg(F.count("*").alias("n"))


@query("""SELECT event_id, 'User' AS direct, NULL::VARCHAR AS nested, CASE WHEN event_id % 2 = 0 THEN 'Group' ELSE 'User' END AS other FROM events""")
def sibling_types(spark, sf_dir):
    """principaltype comes before objecttype, in any case of letters; it reaches an object's own values, and none in its lists."""
    none = F.lit(None).cast("string")
    first = F.when(F.col("event_id") % 2 == 0, '{"o": {"OBJECTTYPE": "Group", "v": 1}').otherwise('{"o": {"ObjectType": "Group", "principalType": "User", "v": 1}')
    body = F.concat(first, F.lit(', "d": {"PrincipalType": "User", "ObjectType": "Group", "v": "x", "l": ["y"]}}'))
    objects = table(spark, sf_dir, "events").select(F.lit("e").alias("member"), F.lit(1).alias("part"), F.col("event_id").alias("idx"), none.alias("key"), F.lit("User").alias("node_type"), none.alias("object_identifier"), F.lit("custom").alias("privacy"), none.alias("catalog_rule_id"), body.alias("body"))
    at = lambda p, name: F.max(F.when(F.col("path") == p, F.col("ref_type"))).alias(name)
    return flatten.leaves(objects, {}, None).groupBy(F.col("idx").alias("event_id")).agg(at("d.v", "direct"), at("d.l[0]", "nested"), at("o.v", "other"))


@query("SELECT event_id, '{\"meta\": {\"type\": \"users\"}, \"data\": [{\"k\": ' || event_id || '}, {\"k\": -1}], \"x\": [' || event_id || ']}' AS body FROM events")
def document_layout(spark, sf_dir):
    """Documents taken apart and put together: the meta block first, objects in order, other root keys last."""
    n = F.col("event_id").cast("string")
    raw = F.concat(F.lit('{"x":['), n, F.lit('],"data":[{"k":'), n, F.lit('},{"k":-1}],"meta":{"type":"users"}}'))
    own = flatten.objects(table(spark, sf_dir, "events").select(n.alias("member"), raw.cast("binary").alias("raw")))
    key = F.when(F.col("part") == flatten.REST, F.col("key")).otherwise(F.lit("data[0]"))
    return flatten.documents(own.select("member", "part", "idx", key.alias("record"), "body")).select(F.col("member").cast("long").alias("event_id"), "body")


@query("SELECT event_id, event_id % 4 = 0 AS accepted FROM events")
def document_acceptance(spark, sf_dir):
    """What is no collection document is left out: no data array, no meta object, an empty type."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '{"data": [], "meta": {"type": "users"}}').when(k == 1, '{"data": {}, "meta": {"type": "users"}}').when(k == 2, '{"data": [], "meta": {"type": ""}}').otherwise('[{"data": []}]')
    members = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("member"), raw.cast("binary").alias("raw"))
    left = audit.skipped(members, flatten.objects(members)).select("member", F.lit(False).alias("accepted"))
    return members.select("member").join(left, "member", "left").select(F.col("member").cast("long").alias("event_id"), F.coalesce("accepted", F.lit(True)).alias("accepted"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\btheory\\b', 'LONG', 'gi'), '\\bthe\\b', 'SHORT', 'gi')) AS digest FROM documents")
def scrub_longest_first(spark, sf_dir):
    """Of a word and its beginning, both known, the longer one is replaced."""
    own = textops.Text([("accounts", "the", "SHORT"), ("accounts", "theory", "LONG")])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(textops.scrub(F.col("text"), own)["text"].cast("binary")).alias("digest"))


@query("SELECT c_nationkey, CASE c_nationkey % 3 WHEN 0 THEN 'sound' ELSE 'refused' END AS verdict FROM customer GROUP BY c_nationkey")
def mapping_hierarchy(spark, sf_dir):
    """A loaded mapping of each nation's SIDs: sound, with a SID below another domain's pseudonym, or with one arc too few."""
    n, c = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    base = F.concat(F.lit("s-1-5-21-2-2-"), n.cast("string"))
    wrong = F.when(n % 3 == 1, F.lit("s-1-5-21-9-9-9-5")).when(n % 3 == 2, F.lit("s-1-5-21-9-9-9")).otherwise(F.concat(base, F.lit("-5"), c))
    own = table(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lower(adapter.domain_sid(n)), F.lit("-"), c).alias("norm"), wrong.alias("pseudonym_norm"))
    own = own.union(table(spark, sf_dir, "customer").select("c_nationkey", F.lower(adapter.domain_sid(n)), base).distinct()).withColumn("category", F.lit("sids"))
    bad = mapping.hierarchy_faults(own).select(F.split("norm", "-")[4].alias("d")).distinct()
    nations = table(spark, sf_dir, "customer").select("c_nationkey").distinct().withColumn("d", (n + 1000000).cast("string"))
    return nations.join(bad.withColumn("bad", F.lit(True)), "d", "left").select("c_nationkey", F.when(F.col("bad"), "refused").otherwise("sound").alias("verdict"))


@query("""SELECT * FROM (SELECT 'objects' AS item, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n
UNION ALL SELECT 'references', (SELECT count(*) FROM customer) UNION ALL SELECT 'opaque values', (SELECT count(*) FROM customer) UNION ALL SELECT 'undeclared numbers', (SELECT count(*) FROM customer)
UNION ALL SELECT 'objects read back', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) UNION ALL SELECT 'domains in the mapping', (SELECT count(*) FROM nation))""")
def anonymize_published(spark, sf_dir):
    """A whole run from a folder to an archive and its mapping, through the gate: its summary, and what is read back."""
    source, out, at = _folder(spark, "in"), _folder(spark, "out.zip"), _folder(spark, "map.json")
    rows = adapter.members(spark, sf_dir).orderBy("member").toLocalIterator()
    publish.publish(((f"{r.member}.json", bytes(r.raw).decode()) for r in rows), source, None)
    told = job.anonymize(spark, source, out, at, salt=SALT)
    labels = [r for c, r, _ in publish.saved_rows(at, tables.CATALOG_VERSION) if c == "domains" and r.startswith("corp")]
    counts = {
        "objects": sum(told["object_classifications"].values()), "references": told["operations"]["map_reference"], "opaque values": told["operations"]["replace_opaque"], "undeclared numbers": told["audit_codes"]["undeclared-numeric-value"],
        "objects read back": flatten.objects(collection.read_members(spark, out)).where("part = 1").count(), "domains in the mapping": len(labels),
    }
    return spark.createDataFrame(list(counts.items()), "item string, n long")
