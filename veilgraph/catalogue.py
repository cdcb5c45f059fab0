"""Registered queries and their DuckDB SQL.

Replacements themselves are keyed digests that SQL can't compute; queries show them through readable placeholders, round trips, joins back
through the mapping, and counts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, pseudonyms, shapes
from .operators import audit, classify, decide, flatten, mapping, textops, verify
from .plans import adapter, job, tables
from .plans.adapter import table
from .sources import collection

SALT = "0123456789abcdef0123456789abcdef"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def placeholders(values, form: str, keep: bool = False):
    """Values with each identity as M<category|value>, each replaced arc as A<SID>."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        show = {None: lambda t: t, "arc": lambda t: f"-A<{t}>", "kept_arc": lambda t: "-" + t.rpartition("-")[2]}
        return texts.map(lambda v: "".join(show[c](t) if c in show else f"M<{c}|{t}>" for c, t in mapping.cut(form, v, None, keep)), na_action="ignore")

    return run(values)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of the adapter's directory graph, by path and operation, with its replacement."""
    run = job.transform(adapter.members(spark, sf_dir), SALT)
    return run.records.select("member", "record", "operation", "namespace", "rule_id", "output")


def _values(df: DataFrame, form: str, value, keep: bool = False) -> DataFrame:
    return df.select(F.lit(form).alias("form"), value.alias("token"), F.lit(None).cast("string").alias("arg"), F.lit(keep).alias("keep")).distinct()


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.replacements(_values(table(spark, sf_dir, "customer"), "token", F.col("c_name")), SALT)


@query("SELECT je.key AS path, 'int' AS kind, count(*) AS n FROM events, json_each(events.props) AS je GROUP BY ALL")
def flatten_event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    objects = e.select(
        F.lit("events").alias("member"), F.lit(1).alias("part"), F.col("event_id").alias("idx"), F.lit(None).cast("string").alias("key"), F.lit("Unknown").alias("node_type"),
        F.lit(None).cast("string").alias("object_identifier"), F.lit("unknown").alias("privacy"), F.lit(None).cast("string").alias("catalog_rule_id"), F.col("props").alias("body"),
    )
    return flatten.leaves(objects, {}, None).where("kind not in ('mapping', 'list')").groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS renamed, count(DISTINCT je.key) AS names FROM events, json_each(events.props) AS je")
def opaque_rename_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    objects = e.select(F.lit("events").alias("member"), F.lit(1).alias("part"), F.col("event_id").alias("idx"), none.alias("key"), F.lit("User").alias("node_type"), none.alias("object_identifier"), F.lit("custom").alias("privacy"), none.alias("catalog_rule_id"), F.col("props").alias("body"))
    keys = flatten.leaves(objects, tables.known_prefixes(tables.rules()), SALT).where("kind = 'key'")
    return keys.agg(F.count("*").alias("renamed"), F.count_distinct("record").alias("_r"), F.count_distinct("token").alias("names")).select("renamed", "names")


@query(r"""SELECT r_name, p.path, lower(regexp_replace(p.path, '\[[0-9]+\]', '[]', 'g')) AS canonical
FROM region, (VALUES ('Aces[3].PrincipalSID'), ('Properties.Name'), ('Members[0].ObjectIdentifier'), ('data[12].Links[1].GUID')) AS p(path)""")
def path_canonicalize(spark, sf_dir):
    p = spark.createDataFrame([("Aces[3].PrincipalSID",), ("Properties.Name",), ("Members[0].ObjectIdentifier",), ("data[12].Links[1].GUID",)], "path string")
    return table(spark, sf_dir, "region").select("r_name").join(F.broadcast(p)).select("r_name", "path", paths.canonical_plain(F.col("path")).alias("canonical"))


@query("SELECT user_id, min(event_id) AS place, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_duplicate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("ord"), "event_type")
    return collection.latest_by_name(e).select(F.col("name").alias("user_id"), F.col("ord").alias("place"), "event_type")


@query("SELECT n_name, printf('member-%05d.json', row_number() OVER (ORDER BY n_name)) AS member FROM nation")
def member_numbering(spark, sf_dir):
    return collection.numbered(table(spark, sf_dir, "nation").select("n_name"), "n_name").select("n_name", "member")


@query("""SELECT source, count(*) AS n, max(strlen(text)) AS most, CAST(sum(strlen(text)) AS BIGINT) AS total, count(*) > 10000 OR 4000 * max(strlen(text)) > 536870912 OR 4000 * sum(strlen(text)) > 2147483648 AS refused
FROM documents GROUP BY source""")
def size_guard(spark, sf_dir):
    """Each source as a collection whose members are 4,000 times as long."""
    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("b"))
    own = d.groupBy("source").agg(F.count("*").alias("n"), F.max("b").alias("most"), F.sum("b").alias("total"))
    return own.withColumn("refused", collection.over_limits(F.col("n"), 4000 * F.col("most"), 4000 * F.col("total")))


@query(r"""WITH t AS (SELECT unnest(string_split_regex(text, '[ \t\n]+')) AS w FROM documents)
SELECT CASE WHEN regexp_full_match(w, '(?i)S-\d+-\d+(?:-\d+)+') THEN 'SID' WHEN regexp_full_match(w, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32}') THEN 'GUID'
WHEN regexp_full_match(w, '[0-9]+(?:\.[0-9]+){2,}') THEN 'OID' ELSE 'NAME' END AS shape, count(*) AS n FROM t WHERE w <> '' GROUP BY 1""")
def shape_classify_tokens(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n]+")).alias("w")).where("w <> ''")
    return w.groupBy(decide._group(F.col("w")).alias("shape")).agg(F.count("*").alias("n"))


# Collection types in several spellings, and paths, that the next queries deal to the parts.
META_TYPES = ("users", "Computers", "OUS", "foreignsecurityprincipals", "azbase", "GPOs", "domains", "groups ", "certTemplates", "meta")
SECRET_PATHS = ("Properties.unixpassword", "Properties.LMHash[3]", "Properties.name", "a.password.b", "pwd", "Properties.UserPassword", "Properties.passwordnotreqd")


def _dealt(spark, sf_dir, values):
    """p_partkey with one of the values."""
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int")).alias("v"))


def _dealt_sql(values):
    return f"(SELECT p_partkey, list_extract([{', '.join(repr(v) for v in values)}], CAST(p_partkey % {len(values)} + 1 AS INTEGER)) AS v FROM part)"


@query(f"""SELECT p_partkey, v AS meta_type, CASE lower(v) WHEN 'users' THEN 'User' WHEN 'computers' THEN 'Computer' WHEN 'ous' THEN 'OU' WHEN 'foreignsecurityprincipals' THEN 'Base' WHEN 'gpos' THEN 'GPO'
WHEN 'domains' THEN 'Domain' WHEN 'certtemplates' THEN 'CertTemplate' WHEN 'meta' THEN 'Meta' ELSE 'Unknown' END AS node_type FROM {_dealt_sql(META_TYPES)}""")
def node_type_map(spark, sf_dir):
    return _dealt(spark, sf_dir, META_TYPES).select("p_partkey", F.col("v").alias("meta_type"), classify.node_type(F.col("v")).alias("node_type"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'rid.domain-admins' WHEN c_custkey % 4 = 1 THEN 'sid.5.11' WHEN c_custkey % 4 = 2 THEN 'wkguid.computers' END AS catalog_rule_id,
CASE WHEN c_custkey % 4 = 3 THEN 'custom' ELSE 'core_global_default' END AS privacy FROM customer""")
def catalog_classify(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    none = F.lit(None).cast("string")
    o = c.select(
        F.lit("m").alias("member"), F.lit(1).alias("part"), F.col("c_custkey").alias("idx"), F.when(k == 2, "containers").otherwise("groups").alias("meta_type"), none.alias("name"), none.alias("templatename"),
        F.when(k == 0, F.concat(adapter.domain_sid(F.col("c_nationkey")), F.lit("-512"))).when(k == 1, "s-1-5-11").otherwise("S-1-5-21-1-2-3-1100").alias("object_identifier"),
        F.when(k == 2, "AA312825768811D1ADED00C04FD8D5CD").alias("wkguid"),
    )
    return classify.contexts(o).select(F.col("idx").alias("c_custkey"), "catalog_rule_id", "privacy")


@query(f"""SELECT p_partkey, v AS node_type, CASE v WHEN 'Domain' THEN 'identity.domain-name' WHEN 'Computer' THEN 'identity.computer-name' WHEN 'CertTemplate' THEN 'identity.template-name'
WHEN 'ADLocalGroup' THEN 'identity.local-group-composite' ELSE 'common.properties-name' END AS rule_id, CASE v WHEN 'Domain' THEN 'domains' WHEN 'Computer' THEN 'hosts' WHEN 'CertTemplate' THEN 'cert_templates'
WHEN 'ADLocalGroup' THEN NULL ELSE 'accounts' END AS namespace FROM {_dealt_sql(("Domain", "Computer", "User", "Unknown", "CertTemplate", "ADLocalGroup"))}""")
def rule_lookup_priority(spark, sf_dir):
    v = _dealt(spark, sf_dir, ("Domain", "Computer", "User", "Unknown", "CertTemplate", "ADLocalGroup")).select("p_partkey", F.col("v").alias("node_type"), F.lit("properties.name").alias("canonical"))
    return decide.with_rules(v, tables.rules()).select("p_partkey", "node_type", "rule.rule_id", "rule.namespace")


@query("SELECT p_type, p_type IN ('Global', 'DomainLocal', 'Universal') AS kept, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'Global' WHEN 1 THEN 'global' ELSE p_type END AS p_type FROM part) GROUP BY ALL")
def schema_allow_list(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.expr("CASE p_size % 3 WHEN 0 THEN 'Global' WHEN 1 THEN 'global' ELSE p_type END").alias("p_type"))
    rows = decide.with_rules(p.withColumn("node_type", F.lit("Group")).withColumn("canonical", F.lit("properties.grouptype")), tables.rules())
    return rows.groupBy("p_type", F.array_contains("rule.allowed", F.col("p_type")).alias("kept")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, v AS path, lower(regexp_replace(list_extract(string_split(v, '.'), -1), '\\[[0-9]+\\]$', '')) IN ('unixpassword', 'lmhash', 'pwd', 'userpassword') AS is_secret FROM {_dealt_sql(SECRET_PATHS)}")
def secret_key_redaction(spark, sf_dir):
    return _dealt(spark, sf_dir, SECRET_PATHS).select("p_partkey", F.col("v").alias("path"), decide.secret(F.col("v")).alias("is_secret"))


@query("""SELECT kind, out, count(*) AS n FROM (SELECT 'int' AS kind, CASE WHEN l_linenumber - 2 = -1 THEN '-2' ELSE '-1' END AS out FROM lineitem UNION ALL
SELECT 'float', CASE WHEN s_acctbal = -1.0 THEN '-2.0' ELSE '-1.0' END FROM supplier) GROUP BY ALL""")
def number_sentinel(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.lit("int").alias("kind"), (F.col("l_linenumber") - 2).cast("string").alias("token"))
    b = table(spark, sf_dir, "supplier").select(F.lit("float").alias("kind"), F.col("s_acctbal").cast("string").alias("token"))
    return a.union(b).groupBy("kind", decide.sentinel(F.col("token"), F.col("kind")).alias("out")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, 'M<domains|corp' || n_nationkey || '>.LOCAL' AS out FROM nation")
def domain_labels(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", placeholders(adapter.domain_name(F.col("n_nationkey")), "domain").alias("out"))


@query("SELECT s_suppkey, 'M<hosts|srv' || s_suppkey || '>.M<domains|corp' || s_nationkey || '>.LOCAL' AS out FROM supplier")
def host_split(spark, sf_dir):
    v = F.concat(F.lit("SRV"), F.col("s_suppkey").cast("string"), F.lit("."), adapter.domain_name(F.col("s_nationkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", placeholders(v, "host").alias("out"))


@query("SELECT c_custkey, 'M<accounts|user' || c_custkey || '>@M<domains|corp' || c_nationkey || '>.LOCAL' AS out FROM customer")
def upn_split(spark, sf_dir):
    v = F.concat(adapter.user_name(F.col("c_custkey")), F.lit("@"), adapter.domain_name(F.col("c_nationkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", placeholders(v, "address").alias("out"))


@query(r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS v FROM documents), p AS (SELECT *, string_split(split_part(v, '@', 2), '.') AS l FROM e)
SELECT doc_id, v, 'M<accounts|' || split_part(v, '@', 1) || '>@' || list_aggregate(list_transform(range(1, len(l) + 1), lambda k: CASE WHEN k = len(l) AND lower(l[k]) IN ('local', 'com', 'net', 'org') THEN l[k]
ELSE 'M<domains|' || lower(l[k]) || '>' END), 'string_agg', '.') AS out, count(*) AS n FROM p GROUP BY ALL""")
def email_split(spark, sf_dir):
    pattern = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern))).alias("v"))
    return e.groupBy("doc_id", "v").agg(F.count("*").alias("n")).withColumn("out", placeholders(F.col("v"), "address"))


@query("SELECT s_suppkey, 'HOST/M<hosts|srv' || s_suppkey || '>.M<domains|corp' || s_nationkey || '>.LOCAL:1433/M<hosts|inst' || (s_suppkey % 3) || '>' AS out FROM supplier")
def spn_parse(spark, sf_dir):
    s = F.col("s_suppkey")
    v = F.concat(F.lit("HOST/SRV"), s.cast("string"), F.lit("."), adapter.domain_name(F.col("s_nationkey")), F.lit(":1433/INST"), (s % 3).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", placeholders(v, "spn").alias("out"))


@query("SELECT s_suppkey, 'CN=M<accounts|Srv' || s_suppkey || '>,OU=M<accounts|Servers>,DC=M<domains|corp' || s_nationkey || '>,DC=local' AS out FROM supplier")
def dn_parse(spark, sf_dir):
    v = F.concat(F.lit("CN=Srv"), F.col("s_suppkey").cast("string"), F.lit(",OU=Servers,DC=Corp"), F.col("s_nationkey").cast("string"), F.lit(",DC=local"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", placeholders(v, "dn").alias("out"))


@query("SELECT s_suppkey, 'M<accounts|Admins' || (s_suppkey % 5) || '>@M<hosts|srv' || s_suppkey || '>.M<domains|corp>.LOCAL' AS out FROM supplier")
def local_group_split(spark, sf_dir):
    s = F.col("s_suppkey")
    v = F.concat(F.lit("Admins"), (s % 5).cast("string"), F.lit("@SRV"), s.cast("string"), F.lit(".CORP.LOCAL"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", placeholders(v, "group_at").alias("out"))


@query("""WITH s AS (SELECT c_custkey, 'S-1-5-21-' || (c_nationkey + 1000000) || '-' || (c_nationkey + 2000000) || '-' || (c_nationkey + 3000000) AS p FROM customer)
SELECT c_custkey, 'M<sids|' || p || '>-A<' || p || '-' || (c_custkey + 1100) || '>' AS out, 'M<sids|' || p || '>-' || (c_custkey + 1100) AS kept FROM s""")
def sid_hierarchy(spark, sf_dir):
    v = F.concat_ws("-", adapter.domain_sid(F.col("c_nationkey")), (F.col("c_custkey") + 1100).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", placeholders(v, "sid").alias("out"), placeholders(v, "sid", True).alias("kept"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(split_part(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '.', 1)) AS host FROM pages""")
def url_decompose(spark, sf_dir):
    out = placeholders(F.col("url"), "url_")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(out, r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(out, r"M<hosts\|([^>]*)>", 1).alias("host"))


@query("""SELECT * FROM (SELECT 'accounts' AS category, count(DISTINCT lower(c_name)) AS n FROM customer UNION ALL SELECT 'hosts', count(DISTINCT lower(s_name)) FROM supplier UNION ALL SELECT 'domains', count(DISTINCT lower(n_name)) FROM nation)""")
def identity_distinct_counts(spark, sf_dir):
    v = _values(table(spark, sf_dir, "customer"), "token", F.col("c_name")).union(_values(table(spark, sf_dir, "supplier"), "host", F.regexp_replace("s_name", r"\.", "_"))).union(_values(table(spark, sf_dir, "nation"), "domain", F.col("n_name")))
    return mapping.category_counts(mapping.registry(mapping.identities(mapping.replacements(v, SALT))))


@query("SELECT lower(n_name) AS norm, lower(n_name) AS real FROM nation")
def preferred_spelling(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    v = _values(n, "token", F.upper("n_name")).union(_values(n, "token", F.lower("n_name"))).union(_values(n, "token", F.initcap("n_name")))
    return mapping.registry(mapping.identities(mapping.replacements(v, SALT))).select("norm", "real")


@query("SELECT 0::BIGINT AS problems")
def registry_collision_check(spark, sf_dir):
    return mapping.problems(mapping.registry(mapping.identities(_people(spark, sf_dir)))).agg(F.count("*").alias("problems"))


@query("""SELECT * FROM (SELECT 'accounts' AS category, 'leaves its source unchanged' AS problem, count(*) FILTER (c_custkey % 10 = 0) AS n FROM customer
UNION ALL SELECT 'accounts', 'conflicts with structured output', count(*) FILTER (c_custkey % 10 = 1) FROM customer UNION ALL SELECT 'accounts', 'pseudonym collision', 1 FROM customer WHERE c_custkey = 2) WHERE n > 0""")
def registry_faults(spark, sf_dir):
    """Customers' identities with planted faults: some map to themselves, some have two pseudonyms, some share one."""
    key = F.regexp_extract("real", r"([0-9]+)\z", 1).cast("long") % 10
    reg = mapping.registry(mapping.identities(_people(spark, sf_dir)))
    reg = reg.withColumn("pseudonym_norm", F.when(key == 0, F.col("norm")).when(key == 2, "shared").otherwise(F.col("pseudonym_norm"))).withColumn("variants", F.when(key == 1, 2).otherwise(F.col("variants")))
    return mapping.problems(reg)


@query("SELECT c_custkey, c_name, c_name AS restored FROM customer")
def pseudonym_roundtrip(spark, sf_dir):
    done = _people(spark, sf_dir)
    reg = mapping.registry(mapping.identities(done))
    got = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("token")).join(done.select("token", "output"), "token")
    return got.join(mapping.owners(reg).select(F.col("pseudonym").alias("output"), F.col("real").alias("restored")), "output").select("c_custkey", F.col("token").alias("c_name"), "restored")


@query("SELECT c_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name")
def revenue_by_pseudonym(spark, sf_dir):
    done = _people(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("token")).join(done.select("token", "output"), "token").select("c_custkey", "output")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    agg = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("output").agg(F.count("*").alias("orders"), F.sum("p").cast("double").alias("revenue"))
    back = mapping.owners(mapping.registry(mapping.identities(done))).select(F.col("pseudonym").alias("output"), F.col("real").alias("c_name"))
    return agg.join(back, "output").select("c_name", "orders", "revenue")


@query("SELECT c_nationkey, count(*) AS edges, count(DISTINCT o_custkey) AS sources FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def edge_preservation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat_ws("-", adapter.domain_sid(F.col("c_nationkey")), (F.col("c_custkey") + 1100).cast("string")).alias("token"))
    done = mapping.settled(_values(c, "sid", F.col("token")), SALT, {}, job.frozen).select("token", "output")
    parents = mapping.replacements(_values(c, "sid", adapter.domain_sid(F.col("c_nationkey"))), SALT).select(F.col("token").alias("domain"), F.col("output").alias("parent"))
    nodes = c.join(done, "token").select("c_custkey", "output", F.regexp_extract("output", r"^(S-1-5-21-\d+-\d+-\d+)", 1).alias("parent"))
    edges = table(spark, sf_dir, "orders").select("o_custkey").join(nodes, F.col("o_custkey") == F.col("c_custkey")).groupBy("parent").agg(F.count("*").alias("edges"), F.count_distinct("output").alias("sources"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), adapter.domain_sid(F.col("n_nationkey")).alias("domain"))
    return edges.join(parents, "parent").join(names, "domain").select("c_nationkey", "edges", "sources")


@query("""SELECT * FROM (SELECT 'map_custom_identifier' AS operation, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n
UNION ALL SELECT 'map_reference', (SELECT count(*) FROM customer) UNION ALL SELECT 'map_identity', 3 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation)
UNION ALL SELECT 'parse_spn', (SELECT count(*) FROM supplier) UNION ALL SELECT 'parse_dn', (SELECT count(*) FROM nation) UNION ALL SELECT 'replace_opaque', (SELECT count(*) FROM customer)
UNION ALL SELECT 'preserve_schema_value', (SELECT count(*) FROM supplier) + (SELECT count(DISTINCT (c_nationkey, c_custkey // 100000)) FROM customer) + (SELECT count(DISTINCT (s_nationkey, s_suppkey // 100000)) FROM supplier) + 1)""")
def audit_counts(spark, sf_dir):
    run = job.transform(adapter.members(spark, sf_dir), SALT)
    return run.audit().where("section = 'operations'").select(F.col("item").alias("operation"), "n")


@query("SELECT 0::BIGINT AS findings")
def verify_full_outer(spark, sf_dir):
    return job.transform(adapter.members(spark, sf_dir), SALT).findings.agg(F.count("*").alias("findings"))


@query("SELECT 'value-type-mismatch' AS code, count(*) AS n FROM customer")
def verify_tampered(spark, sf_dir):
    """Every user's ``enabled`` flag is turned into a string after the fact."""
    run = job.transform(adapter.members(spark, sf_dir), SALT)
    changed = run.leaves.withColumn("kind", F.when(F.col("canonical") == "properties.enabled", "string").otherwise(F.col("kind")))
    outs = run.records.select("member", "record", F.col("output").alias("o")).unionByName(run.numbers.select("member", "record", F.col("out").alias("o")))
    output = changed.join(outs, ["member", "record"], "left").select("member", "record", "kind", F.coalesce("o", "token").alias("token"))
    found = verify.findings(run.leaves, output, run.decided, run.numbers, run.registry, run.records.select("member", "record", "token", "output"), SALT, job.frozen)
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT code, sum(n)::BIGINT AS n FROM (SELECT CASE c_custkey % 10 WHEN 0 THEN 'value-type-mismatch' WHEN 1 THEN 'source-output-topology-mismatch' WHEN 2 THEN 'identity-not-transformed' WHEN 3 THEN 'mapped-value-mismatch'
WHEN 4 THEN 'reference-mapping-mismatch' WHEN 5 THEN 'undeclared-numeric-not-redacted' WHEN 6 THEN 'schema-value-mismatch' WHEN 7 THEN 'registry-mapping-missing' END AS code, count(*) AS n FROM customer GROUP BY 1
UNION ALL SELECT 'policy-record-mismatch', count(*) FROM customer WHERE c_custkey % 10 BETWEEN 1 AND 4) WHERE code IS NOT NULL GROUP BY code""")
def verify_each_code(spark, sf_dir):
    """After the fact, of every tenth user each: the flag becomes a string, the account is gone, stays as it was, becomes another, the group's SID becomes another, the employee number
    stays, the flag is turned, the account has no row in the mapping table."""
    run = job.transform(adapter.members(spark, sf_dir), SALT)
    outs = run.records.select("member", "record", F.col("output").alias("o")).unionByName(run.numbers.select("member", "record", F.col("out").alias("o")))
    key = F.regexp_extract("record", r"\Adata\[([0-9]+)\]", 1).try_cast("long")
    number = run.leaves.where("canonical = 'properties.employeenumber' and kind = 'int'").select("member", key.alias("_i"), (F.col("token").cast("long") % 10).alias("k"))
    own = run.leaves.join(outs, ["member", "record"], "left").withColumn("_i", key).join(number, ["member", "_i"], "left")
    at = lambda path, k: (F.col("canonical") == path) & (F.col("k") == k)
    name, flag = "properties.samaccountname", "properties.enabled"
    out = F.coalesce("o", "token")
    changed = F.when(at(name, 2), F.col("token")).when(at(name, 3), "someone").when(at("primarygroupsid", 4), "S-1-5-21-1-1-1-513").when(at("properties.employeenumber", 5), F.col("token")).when(at(flag, 6), "false").otherwise(out)
    output = own.where(~F.coalesce(at(name, 1), F.lit(False))).select("member", "record", F.when(at(flag, 0), "string").otherwise(F.col("kind")).alias("kind"), changed.alias("token"))
    lost = run.leaves.join(number.withColumnRenamed("k", "_k"), (run.leaves.member == number.member) & (key == F.col("_i"))).where((F.col("canonical") == name) & (F.col("_k") == 7)).select(F.lower("token").alias("norm"), F.lit("accounts").alias("category"))
    registry = run.registry.join(lost.distinct(), ["norm", "category"], "left_anti")
    records = run.records.select("member", "record", "token", "output", *verify.JUDGED)
    found = verify.findings(run.leaves, output, run.decided, run.numbers, registry, records, SALT, job.frozen)
    one_each = found.where(~((F.col("code") == "registry-mapping-missing") & ~F.col("path").endswith("samaccountname")))
    return one_each.groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT code, count(*) AS n FROM (SELECT CASE event_id % 10 WHEN 0 THEN 'record-missing' WHEN 1 THEN 'record-duplicate' WHEN 2 THEN 'policy-record-mismatch' WHEN 3 THEN 'policy-record-mismatch' WHEN 4 THEN 'record-extra' END AS code
FROM events) WHERE code IS NOT NULL GROUP BY code""")
def record_cardinality(spark, sf_dir):
    """An event is a string leaf. Every tenth each has no record, has two, has one of another output, of another decision, or has a record beside its own."""
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("member"), F.col("event_id").cast("string").alias("record"), F.col("event_type").alias("a"), F.concat(F.lit("x"), "event_type").alias("b"), F.struct(F.lit("map_identity").alias("operation")).alias("judged"), (F.col("event_id") % 10).alias("k"))
    own = e.where("k <> 0").select("member", "record", F.col("a").alias("token"), F.when(F.col("k") == 2, "else").otherwise(F.col("b")).alias("output"), F.when(F.col("k") == 3, F.struct(F.lit("replace_opaque").alias("operation"))).otherwise(F.col("judged")).alias("judged"), "k")
    more = own.where("k = 1").union(own.where("k = 4").withColumn("record", F.concat("record", F.lit("+"))))
    return verify.record_findings(e.drop("k"), own.union(more).drop("k"), SALT).groupBy("code").agg(F.count("*").alias("n"))


def _preflight(spark, sf_dir):
    return flatten.objects(adapter.members(spark, sf_dir))


@query("SELECT * FROM (SELECT 'computers' AS meta_type, count(DISTINCT (s_nationkey, s_suppkey // 100000)) AS members FROM supplier UNION ALL SELECT 'users', count(DISTINCT (c_nationkey, c_custkey // 100000)) FROM customer) WHERE members > 1")
def preflight_duplicates(spark, sf_dir):
    return audit.duplicate_types(_preflight(spark, sf_dir))


@query("SELECT t.v AS meta_type FROM (VALUES ('users'), ('computers'), ('groups'), ('domains')) AS t(v) WHERE t.v NOT IN (SELECT 'users' FROM customer UNION SELECT 'computers' FROM supplier UNION SELECT 'domains' FROM nation)")
def preflight_missing(spark, sf_dir):
    return audit.missing_types(_preflight(spark, sf_dir))


@query("SELECT 'computers' AS meta_type, 'Computer' AS node_type, count(*) AS objects FROM supplier UNION ALL SELECT 'users', 'User', count(*) FROM customer UNION ALL SELECT 'domains', 'Domain', count(*) FROM nation")
def collection_types(spark, sf_dir):
    return audit.type_rows(_preflight(spark, sf_dir)).select("meta_type", "node_type", "objects")


@query("SELECT 0::BIGINT AS wrong")
def preflight_count_mismatch(spark, sf_dir):
    return audit.wrong_counts(_preflight(spark, sf_dir)).agg(F.count("*").alias("wrong"))


@query("SELECT 'users-' || lpad(c_nationkey::VARCHAR, 5, '0') || '-' || (c_custkey // 100000) AS member, count(*) + 1 AS declared, count(*) AS items FROM customer WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey, c_custkey // 100000")
def preflight_wrong_counts(spark, sf_dir):
    """Every second nation's users are declared one too many."""
    text, even = F.col("raw").cast("string"), (F.substring("member", 7, 5).try_cast("int") % 2 == 0) & F.col("member").startswith("users-")
    declared = F.get_json_object(text, "$.meta.count").cast("long")
    raised = F.replace(text, F.concat(F.lit('"count":'), declared.cast("string")), F.concat(F.lit('"count":'), (declared + 1).cast("string")))
    members = adapter.members(spark, sf_dir).withColumn("raw", F.when(even, raised.cast("binary")).otherwise(F.col("raw")))
    return audit.wrong_counts(flatten.objects(members)).select("member", F.col("declared").cast("long").alias("declared"), "items")


@query("SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def top_unknown_paths(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("unknown_paths"))
    return audit.top(counts).select("item", "n")


def _words(spark) -> textops.Text:
    return textops.Text([("accounts", w, f"zz{k}zz") for k, w in enumerate(("the", "of", "and", "que", "der"))])


def _word_counts(docs: DataFrame) -> DataFrame:
    got = docs.select("doc_id", textops.scrub(F.col("text"), _words(docs.sparkSession)).alias("s"))
    return got.select("doc_id", F.coalesce(F.aggregate(F.map_values("s.counts"), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).alias("n"))


@query(r"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '(?i)\b(?:the|of|and|que|der)\b')), 0) AS BIGINT) AS n FROM documents")
def scrub_word_boundary(spark, sf_dir):
    """Word boundaries are ASCII, whatever letters stand beside."""
    return _word_counts(table(spark, sf_dir, "documents"))


SWEPT = {"the": "w1", "of": "w2", "que": "w3", "Der": "w4", "THE": "never"}


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bthe\b', 'w1', 'gi'), '\bof\b', 'w2', 'gi'), '\bque\b', 'w3', 'gi'), '\bder\b', 'w4', 'gi')) AS digest FROM documents")
def token_sweep(spark, sf_dir):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: textops.sweep(t, SWEPT), na_action="ignore")

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(run("text").cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '(?i)\b(?:the|of|que|der)\b'))), 'string_agg', ','), '')) AS found FROM documents")
def tokens_found(spark, sf_dir):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ",".join(sorted(textops.find_tokens(t or "", list(SWEPT)))))

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(run("text").cast("binary")).alias("found"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def scrub_restore_documents(spark, sf_dir):
    own = textops.Text([("opaque", w, f"[REDACTED:{w}q]") for w in ("the", "of", "and", "que", "der")])
    d = table(spark, sf_dir, "documents").select("doc_id", textops.scrub(F.col("text"), own)["text"].alias("t"))
    return d.select("doc_id", F.md5(textops.restore(F.col("t"), own).cast("binary")).alias("digest"))


@query("SELECT c_custkey, c_name AS real FROM customer")
def lookup_forward(spark, sf_dir):
    done = _people(spark, sf_dir)
    reg = mapping.registry(mapping.identities(done))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("real"))
    there = mapping.forward(reg, c.select("real")).where("category = 'accounts'")
    back = mapping.reverse(reg, there.select("pseudonym")).where("category = 'accounts'").select("asked", "real")
    return there.select(F.col("asked").alias("source"), "pseudonym").join(back, F.col("pseudonym") == F.col("asked")).join(c.withColumnRenamed("real", "source"), "source").select("c_custkey", "real")


@query("SELECT n_name, lower(n_name) AS folded FROM nation")
def case_folding(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", shapes.fold(F.col("n_name")).alias("folded"))


@query()
def blake2_fingerprint(spark, sf_dir):
    """A keyed digest has no SQL."""

    @F.pandas_udf("string")
    def mark(v: pd.Series) -> pd.Series:
        return v.map(lambda x: pseudonyms.mark(pseudonyms.seed(SALT, "accounts", x)))

    return table(spark, sf_dir, "customer").select("c_custkey", mark("c_name").alias("fingerprint"))


@query()
def anonymize_graph(spark, sf_dir):
    """The whole run: replaced documents, after the gate found nothing."""
    run = job.transform(adapter.members(spark, sf_dir), SALT)
    if not run.findings.isEmpty():
        raise job.LeakError("verification failed")
    return run.documents()
