"""Registered queries on decisions, evidence, pieces and known values; they join those of ``catalogue``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .catalogue import SALT, placeholders, query
from .functions import jsontext, pseudonyms
from .operators import decide, flatten, textops, verify
from .plans import adapter, tables
from .plans.adapter import table
from .plans.tables import Config
from .sources import collection

GUID = "12345678-1234-1234-1234-123456789abc"
# Node type, path, value, and what becomes of it - operation, namespace, audit code.
CASES = (
    ("User", "Aces[0].RightName", "GenericAll", "preserve_schema_value", None, None),
    ("User", "Aces[0].RightName", "zqright", "replace_opaque", "opaque", "invalid-schema-string"),
    ("User", "PrimaryGroupSID", "S-1-5-21-1-2-3-1105", "map_reference", "sids", None),
    ("User", "PrimaryGroupSID", GUID, "map_reference", "guids", None),
    ("User", "PrimaryGroupSID", "S-1-5-21-1-2-3-1105-", "replace_opaque", "opaque", "malformed-source-value"),
    ("User", "Properties.zq", "S-1-5-21-1-2-3-1105", "map_custom_identifier", "sids", "unknown-sid-path"),
    ("User", "Properties.zq", GUID, "map_custom_identifier", "guids", "unknown-guid-path"),
    ("User", "Properties.zq", "1.2.3.4", "map_custom_identifier", "oids", "unknown-oid-path"),
    ("User", "Properties.zq", "words", "replace_opaque", "opaque", "unknown-string-path"),
    ("Domain", "Properties.name", "CORP.LOCAL", "map_identity", "domains", None),
    ("Computer", "Properties.name", "a..b", "replace_opaque", "opaque", "malformed-source-value"),
    ("User", "Properties.name", "JDOE@", "replace_opaque", "opaque", "malformed-source-value"),
    ("User", "Properties.name", "JDOE", "map_identity", "accounts", None),
    ("User", "Properties.distinguishedname", "CN=a,DC=b", "parse_dn", None, None),
    ("User", "Properties.distinguishedname", "X=a,DC=b", "replace_opaque", "opaque", "malformed-source-value"),
    ("User", "Properties.serviceprincipalnames[0]", "HOST/a.b", "parse_spn", None, None),
    ("User", "Properties.serviceprincipalnames[0]", "HOST", "replace_opaque", "opaque", "malformed-source-value"),
    ("User", "Aces[0].PrincipalSID", "S-1-5-11", "preserve_constant", None, None),
    ("User", "Members[0].ObjectType", "User", "preserve_schema_value", None, None),
    ("Computer", "Properties.operatingsystem", "Windows 10 Pro", "preserve_schema_value", None, None),
    ("Computer", "Properties.operatingsystem", "windows 10 pro", "replace_opaque", "opaque", "invalid-schema-string"),
    ("User", "Properties.description", "words", "replace_opaque", "opaque", None),
    ("CertTemplate", "Properties.oid", "1.3.6.1.5.5.7.3.2", "preserve_constant", None, None),
    ("ADLocalGroup", "Properties.name", "Admins@host", "parse_composite", None, None),
)
# Pseudonyms under the salt 0123456789abcdef0123456789abcdef.
KNOWN = (
    ("domains", "corp.local", "southridge-geafzk36mbevs.local"),
    ("domains", "acme.example", "wingtip-3ylw5maaovys4.example"),
    ("accounts", "Alice", "ihayesgxmq6cq3derry"),
    ("accounts", "administrator", "sjohnso5g2vsr4ez3vte"),
    ("hosts", "DC01", "HOST-73-7HTSG4BESH7BG"),
    ("sids", "S-1-5-21-1111111111-2222222222-3333333333", "S-1-5-21-1708546787-1795253718-634612481"),
    ("guids", GUID, "ec2283da-9c61-ab5b-17c2-4a58e27ac161"),
    ("cert_templates", "WebServer", "Template-6btmxzks3tiyg"),
    ("oids", "1.2.3.4", "2.25.251460502849143529337231328059982147713"),
    ("opaque", "secretvalue", "[REDACTED:fqysiqaed6uhu]"),
)


def _sql(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _case(k: int) -> str:
    return f"CASE c_custkey % {len(CASES)} " + " ".join(f"WHEN {n} THEN {_sql(c[k])}" for n, c in enumerate(CASES)) + " END"


@query(f"SELECT c_custkey, {_case(3)} AS operation, {_case(4)} AS namespace, {_case(5)} AS audit_code FROM customer")
def resolve_operations(spark, sf_dir):
    """Every customer as one of the cases, in a spelling of its own member."""
    from .functions import paths

    rows = [(k, c[0], paths.canonical(c[1]), c[1], c[2]) for k, c in enumerate(CASES)]
    cases = spark.createDataFrame(rows, "k long, node_type string, canonical string, path string, token string")
    own = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % len(CASES)).join(F.broadcast(cases), "k")
    none = F.lit(None).cast("string")
    leaves = own.select("c_custkey", F.lit("string").alias("kind"), "node_type", "canonical", "path", "token", none.alias("ref_type"), none.alias("catalog_rule_id"))
    return decide.resolve(leaves, Config()).select("c_custkey", "operation", "namespace", "audit_code")


def _pseudonyms(category, value):
    @F.pandas_udf("string")
    def run(categories: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([pseudonyms.pseudonym(SALT, c, v) for c, v in zip(categories, values)])

    return run(category, value)


@query("SELECT t.category, t.real, t.pseudonym FROM (VALUES " + ", ".join(f"({', '.join(map(_sql, row))})" for row in KNOWN) + ") AS t(category, real, pseudonym)")
def pseudonym_known_values(spark, sf_dir):
    """A keyed digest has no SQL, so known values stand for it."""
    own = spark.createDataFrame([row[:2] for row in KNOWN], "category string, real string")
    return own.select("category", "real", _pseudonyms(F.col("category"), F.col("real")).alias("pseudonym"))


@query("SELECT count(DISTINCT lower(c_name)) AS identities, count(DISTINCT lower(c_name)) AS pseudonyms, count(*) AS well_formed FROM customer")
def pseudonym_shapes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name", _pseudonyms(F.lit("accounts"), F.upper("c_name")).alias("p"))
    return c.agg(F.count_distinct(F.lower("c_name")).alias("identities"), F.count_distinct("p").alias("pseudonyms"), F.sum(F.col("p").rlike(r"\A[a-z]{4,7}[a-z2-7]{13}\z").cast("long")).alias("well_formed"))


@query("""WITH g AS (SELECT c_custkey, md5(c_name) AS h FROM customer), d AS (SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS v FROM g)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'M<guids|' || v || '>' WHEN 1 THEN '{M<guids|' || v || '>}' ELSE 'M<guids|' || v || '>' END AS out FROM d""")
def guid_forms(spark, sf_dir):
    h, k = F.md5("c_name"), F.col("c_custkey") % 3
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    v = F.when(k == 0, F.upper(dashed)).when(k == 1, F.concat(F.lit("{"), dashed, F.lit("}"))).otherwise(F.concat(F.lit(" "), dashed, F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", placeholders(v, "guid").alias("out"))


@query("SELECT s_suppkey, 'M<accounts|SRV' || s_suppkey || '>' || CASE WHEN s_suppkey % 2 = 0 THEN '$' ELSE '' END AS out FROM supplier")
def machine_account(spark, sf_dir):
    v = F.concat(F.lit("SRV"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "$").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", placeholders(v, "machine").alias("out"))


@query(r"""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '\\M<hosts|srv' || s_suppkey || '>.M<domains|corp>.local\M<accounts|share>\M<accounts|a.txt>' WHEN 1 THEN 'C:\M<accounts|dir' || s_suppkey || '>\M<accounts|a.txt>'
ELSE '/M<accounts|home>/M<accounts|u' || s_suppkey || '>/' END AS out FROM supplier""")
def path_split(spark, sf_dir):
    n, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    v = F.when(k == 0, F.concat(F.lit("\\\\SRV"), n, F.lit(".corp.local\\share\\a.txt"))).when(k == 1, F.concat(F.lit("C:\\dir"), n, F.lit("\\a.txt"))).otherwise(F.concat(F.lit("/home/u"), n, F.lit("/")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", placeholders(v, "path_").alias("out"))


@query(r"""SELECT event_id, '{"b": "\u00e9", "k": ' || CAST(regexp_extract(props, '-?[0-9]+') AS VARCHAR) || ', "n": 1.50}' AS plain, '{"b": "\u00e9", "k": ' || CAST(regexp_extract(props, '-?[0-9]+') AS VARCHAR) || ', "n": 1.50}' AS sorted FROM events""")
def canonical_json(spark, sf_dir):
    """Number tokens as written, of repeated keys the last value, ASCII only, ", " and ": " between."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: jsontext.dumps(jsontext.parse(t)))

    @F.pandas_udf("string")
    def ordered(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: jsontext.dumps(jsontext.parse(t), sort=True))

    k = F.regexp_extract("props", "-?[0-9]+", 0)
    text = F.concat(F.lit('{"b":0 ,"b" : "\u00e9","k":'), k, F.lit(',"n":1.50}'))
    turned = F.concat(F.lit('{"n":1.50,"k":'), k, F.lit(',"b":"\u00e9"}'))
    return table(spark, sf_dir, "events").select("event_id", plain(text).alias("plain"), ordered(turned).alias("sorted"))


@query("SELECT 'collision' AS kind, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'key', 2 * count(*) FROM events")
def key_collisions(spark, sf_dir):
    """Two keys of an object that would become one: in every second event both have the same owner."""
    none = F.lit(None).cast("string")
    body = F.when(F.col("event_id") % 2 == 0, '{"a": 1, "b": 2}').otherwise('{"a": 1, "c": 2}')
    objects = table(spark, sf_dir, "events").select(F.lit("events").alias("member"), F.lit(1).alias("part"), F.col("event_id").alias("idx"), none.alias("key"), F.lit("User").alias("node_type"), none.alias("object_identifier"), F.lit("custom").alias("privacy"), none.alias("catalog_rule_id"), body.alias("body"))
    return flatten.leaves(objects, {}, SALT, {"a": "one", "b": "one"}).where("kind in ('collision', 'key')").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT sha256(string_agg(props, '' ORDER BY event_id)) AS digest FROM events")
def input_digest(spark, sf_dir):
    members = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("props").cast("binary").alias("raw"))
    return spark.createDataFrame([(collection.input_hash(members),)], "digest string")


@query("SELECT c_nationkey, 'rid.domain-users' AS entry, count(*) AS n FROM customer WHERE c_custkey % 3 = 1 AND c_nationkey % 2 = 0 GROUP BY c_nationkey")
def sid_evidence(spark, sf_dir):
    """References to a domain's group 513 where every second domain has evidence of it."""
    nation = F.col("n_nationkey")
    rids = table(spark, sf_dir, "nation").where(nation % 2 == 0).select(F.concat(adapter.domain_sid(nation), F.lit("-513")).alias("sid"), F.lit("rid.domain-users").alias("entry_id"))
    token = F.concat(F.lower(adapter.domain_sid(F.col("c_nationkey"))), F.lit("-"), (F.col("c_custkey") % 3 + 512).cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.lit("m").alias("member"), F.col("c_custkey").cast("string").alias("record"), token.alias("token"))
    return decide.with_evidence(rows, rids).where("_rid is not null").groupBy("c_nationkey", F.col("_rid").alias("entry")).agg(F.count("*").alias("n"))


@query("SELECT 'invalid-target-evidence' AS code, count(*) FILTER (n_nationkey % 4 <> 0) + 1 AS n FROM nation")
def evidence_faults(spark, sf_dir):
    """Evidence of three domains in four is wrong: another entry's, of no domain, not in upper case; and one of two templates is."""
    nation = F.col("n_nationkey")
    sid, k = F.concat(adapter.domain_sid(nation), F.lit("-513")), nation % 4
    rids = table(spark, sf_dir, "nation").select(F.when(k == 2, "S-1-5-32-513").when(k == 3, F.lower(sid)).otherwise(sid).alias("sid"), F.when(k == 1, "rid.domain-admins").otherwise("rid.domain-users").alias("entry_id"))
    entry = {e.value: e.rule_id for e in tables.catalog() if e.kind == "TEMPLATE"}
    templates = spark.createDataFrame([("user", "User", entry["user"]), ("web server", "Web Server", entry["user"])], "folded string, source string, entry_id string")
    return verify.evidence_findings(decide.Evidence(rids, templates), SALT).groupBy("code").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\bthe\b', 'zz-the-zz', 'gi')) AS once, md5(regexp_replace(text, '\bthe\b', 'zz-the-zz', 'gi')) AS twice FROM documents")
def scrub_keeps_pseudonyms(spark, sf_dir):
    """Nothing inside a pseudonym is replaced again."""
    own = textops.Text([("accounts", "the", "zz-the-zz")])
    first = table(spark, sf_dir, "documents").select("doc_id", textops.scrub(F.col("text"), own)["text"].alias("t"))
    return first.select("doc_id", F.md5(F.col("t").cast("binary")).alias("once"), F.md5(textops.scrub(F.col("t"), own)["text"].cast("binary")).alias("twice"))
