import json
import os
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from veilgraph.operators import audit, mapping, verify
from veilgraph.plans import job, tables
from veilgraph.sources import collection, publish

SALT = "00" * 16
SID = "S-1-5-21-1111-2222-3333"


def doc(kind, data, **extra):
    return {"meta": {"type": kind, "count": len(data), "version": 6}, "data": data, **extra}


DOCS = {
    "a.json": doc("users", [
        {"ObjectIdentifier": f"{SID}-1105", "Properties": {"name": "ZQALICE@ZQCORP.LOCAL", "samaccountname": "zqalice", "email": "", "unixpassword": "zqhunter", "employeenumber": 987654321, "functionallevel": -1.0, "whencreated": 12,
         "operatingsystem": "Windows 10 Pro", "zqkey": {"zqinner": "zqvalue"}}, "PrimaryGroupSID": f"{SID}-513", "Aces": [{"PrincipalSID": f"{SID}-512", "PrincipalType": "Group", "RightName": "GenericAll"}, {"PrincipalSID": "aaaaaaaa-1111-2222-3333-444444444444", "PrincipalType": "Container", "RightName": "zqright"}], "SPNTargets": []},
    ]),
    "b.json": doc("groups", [{"ObjectIdentifier": f"{SID}-512", "Properties": {"name": "DOMAIN ADMINS@ZQCORP.LOCAL"}, "Members": [{"ObjectIdentifier": f"{SID}-1105", "ObjectType": "User"}]}]),
    "c.json": doc("containers", [{"ObjectIdentifier": "AAAAAAAA-1111-2222-3333-444444444444", "Properties": {"distinguishedname": "CN=zqbox,DC=zqcorp,DC=local", "description": None}}], zqroot=[1, "S-1-5-21-1-2-3-4"]),
    "d.json": doc("certtemplates", [{"ObjectIdentifier": "bbbbbbbb-1111-2222-3333-444444444444", "Properties": {"name": "User@ZQCORP.LOCAL", "templatename": "User", "oid": "1.3.6.1.5.5.7.3.2", "ekus": ["1.2.3.4"]}}]),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    for name, d in DOCS.items():
        (root / name).write_text(json.dumps(d))
    (root / "notes.json").write_text('["not a collection"]')
    return root


@pytest.fixture(scope="module")
def run(spark, folder):
    return job.transform(collection.read_members(spark, str(folder)), SALT)


def test_replaced_and_clean(run):
    got = {r.member: json.loads(r.body) for r in run.documents().collect()}
    text = json.dumps(got).lower()
    assert len(got) == 4 and "zq" not in text and "987654321" not in text and "1111-2222-3333-1105" not in text
    user = got["member-00001.json"]["data"][0]
    props = user["Properties"]
    assert -1 in props.values() and "[REDACTED]" in props.values()
    assert props["functionallevel"] == -2.0 and props["whencreated"] == 12 and props["operatingsystem"] == "Windows 10 Pro" and props["email"] != ""
    assert user["Aces"][0]["PrincipalSID"].endswith("-512") and user["Aces"][1]["RightName"].startswith("[REDACTED")
    assert user["Aces"][1]["PrincipalSID"] == got["member-00003.json"]["data"][0]["ObjectIdentifier"].lower()
    group = got["member-00002.json"]["data"][0]
    assert group["ObjectIdentifier"] == user["Aces"][0]["PrincipalSID"] and group["Members"][0]["ObjectIdentifier"] == user["ObjectIdentifier"]
    assert group["Properties"]["name"].startswith("DOMAIN ADMINS@") and list(got["member-00003.json"])[:2] == ["meta", "data"]
    template = got["member-00004.json"]["data"][0]["Properties"]
    assert template["templatename"] == "User" and template["name"].startswith("User@") and template["oid"] == "1.3.6.1.5.5.7.3.2" and template["ekus"][0].startswith("2.25.")
    assert run.findings.count() == 0 and mapping.problems(run.registry).count() == 0


def test_order_of_members_changes_nothing(spark, run):
    turned = [(f"x{k}", bytearray(json.dumps(DOCS[n]).encode())) for k, n in enumerate(reversed(DOCS))]
    other = job.transform(spark.createDataFrame(turned, "member string, raw binary"), SALT)
    assert {r.body for r in other.documents().collect()} == {r.body for r in run.documents().collect()}


def test_gate_sees_tampering(run):
    nodes = run.leaves
    outs = run.records.select("member", "record", F.col("output").alias("o")).unionByName(run.numbers.select("member", "record", F.col("out").alias("o")))
    output = nodes.join(outs, ["member", "record"], "left").select("member", "record", "kind", F.coalesce("o", "token").alias("token"))
    records = run.records.select("member", "record", "token", "output")

    def codes(out=output, rec=records, reg=run.registry):
        return {r.code for r in verify.findings(nodes, out, run.decided, run.numbers, reg, rec, SALT).collect()}

    assert codes() == set()
    assert "source-output-topology-mismatch" in codes(output.where("record not like '%samaccountname'"))
    leak = output.withColumn("token", F.when(F.col("record").endswith("samaccountname"), "zqalice").otherwise(F.col("token")))
    assert "identity-not-transformed" in codes(leak)
    assert codes(rec=records.where("record not like '%samaccountname'")) == {"record-missing"}
    assert codes(rec=records.union(records.where("record like '%samaccountname'"))) == {"record-duplicate"}
    assert "registry-mapping-missing" in codes(reg=run.registry.where("category <> 'accounts'"))
    wrong = output.withColumn("token", F.when(F.col("record").endswith("whencreated"), "13").otherwise(F.col("token")))
    assert codes(wrong) == {"schema-value-mismatch"}


def test_audit(run):
    own = audit.summary(run.audit())
    assert own["object_classifications"] == {"core_global_default": 2, "custom": 3 - 1}
    assert own["audit_codes"]["unknown-key-path"] >= 3 and own["audit_codes"]["undeclared-numeric-value"] == 2 and "numeric_passthrough_paths" in own
    assert sum(own["operations"].values()) == run.decided.count()


def test_publish_reuse_restore(spark, folder, tmp_path):
    out, map_ = tmp_path / "out.zip", tmp_path / "map.json"
    job.anonymize(spark, str(folder), str(out), str(map_), salt=SALT)
    assert stat.S_IMODE(os.stat(out).st_mode) == 0o600
    with zipfile.ZipFile(out) as z:
        first = {n: z.read(n) for n in z.namelist()}
    saved = publish.load_mapping(str(map_), tables.CATALOG_VERSION)
    assert saved["salt"] == SALT and saved["categories"]["accounts"]["zqalice"]
    job.anonymize(spark, str(folder), str(tmp_path / "again"), reuse=str(map_))
    assert {n: (tmp_path / "again" / n).read_bytes() for n in first} == first
    texts = spark.createDataFrame([(1, "ask ZQALICE at zqcorp"), (2, None)], "id long, text string")
    done = job.scrub(spark, str(map_), texts)
    assert "zq" not in done.where("id = 1").first().text.lower()
    assert job.restore(spark, str(map_), done.drop("report")).where("id = 1").first().text == "ask zqalice at zqcorp"
    with pytest.raises(publish.PublishError):
        job.anonymize(spark, str(folder), str(out))
    with pytest.raises(publish.PublishError):
        job.anonymize(spark, str(folder), str(folder / "inside"))
    with pytest.raises(publish.PublishError):
        publish.load_mapping(str(map_), 1)


def test_a_wrong_count_publishes_nothing(spark, tmp_path):
    src = tmp_path / "bad.json"
    src.write_text(json.dumps({"meta": {"type": "users", "count": 5}, "data": []}))
    with pytest.raises(job.LeakError):
        job.anonymize(spark, str(src), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path)) == ["bad.json"]
    report = job.inspect(spark, str(src))
    assert report["findings"] and report["wrong_counts"] and report["missing_types"]


def test_archives(spark, tmp_path):
    def archive(name, *items, method=zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            for n, d in items:
                z.writestr(n, d)
        return str(tmp_path / name)

    good = json.dumps(DOCS["b.json"])
    rows = collection.read_members(spark, archive("a.zip", ("Users.JSON", good), ("x.txt", "no"), ("z.json", "1"), ("Users.JSON", "2"), method=zipfile.ZIP_STORED)).orderBy("ord").collect()
    assert [(r.member, bytes(r.raw)) for r in rows] == [("member-00001.json", b"2"), ("member-00002.json", b"1")]
    for bad in (archive("b.zip", ("../x.json", good)), archive("c.zip", ("/x.json", good)), archive("d.zip", ("C:/x.json", good))):
        with pytest.raises(Exception, match="unsafe member name"):
            collection.read_members(spark, bad).count()
    for name, text in (("e.json", "[]"), ("f.json", "prose")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="not a zip file"):
            collection.read_members(spark, str(tmp_path / name)).count()
    os.mkdir(tmp_path / "none")
    with pytest.raises(collection.CollectionError):
        collection.read_members(spark, str(tmp_path / "none"))


def test_streams(spark, tmp_path):
    from veilgraph.streaming.text import scrub_stream

    (tmp_path / "map.json").write_text(json.dumps({"salt": SALT, "format_version": 2, "categories": {"accounts": {"zqalice": "zfoo1"}}}))
    spark.createDataFrame([("hello zqalice",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = scrub_stream(spark, str(tmp_path / "map.json"), stream).select("text").writeStream.format("memory").queryName("scrubbed").start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.table("scrubbed").collect()] == ["hello zfoo1"]


def test_catalog_predicates(spark):
    from veilgraph.operators import classify

    rows = [("S-1-5-32-544", "core_global_default"), ("s-1-5-32-553", "microsoft_feature_default"), ("S-1-5-21-1-2-3-512", "custom"), ("S-1-9", "unknown")]
    got = spark.createDataFrame(rows, "sid string, want string").select(classify.sid_privacy(F.col("sid")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    one = spark.createDataFrame([(" Domain ADMINS ", 512, "31B2F340-016D-11D2-945F-00C04FB984F9"), ("alice", 1104, "31B2F340-016D-11D2-945F-00C04FB984F0")], "n string, r int, g string")
    flags = one.select(classify.is_builtin_name(F.col("n")), classify.is_builtin_rid(F.col("r")), classify.is_wellknown_guid(F.col("g"))).collect()
    assert [tuple(f) for f in flags] == [(True,) * 3, (False,) * 3]
    assert classify.is_core_constant("CertTemplate", "TEMPLATE", "User", "Properties.templatename") and not classify.is_core_constant("User", "TEMPLATE", "User", "Properties.templatename")


V1 = {"salt": SALT, "categories": {"sids": {"1-2-3": "S-1-5-21-7-8-9", "S-1-5-21-1-2-3-1104": "S-1-5-21-4-5-6", "S-1-5-21-1-2-3-1104-77": "S-1-5-21-4-5-66", "S-1-5-32-544": "S-1-5-32-544"}}}


def test_first_format_of_mappings(spark, tmp_path):
    from veilgraph.operators import mapping

    def load(own):
        (tmp_path / "m.json").write_text(json.dumps(own))
        return publish.load_mapping(str(tmp_path / "m.json"))

    saved = load(V1)
    assert saved["categories"]["sids"] == {"S-1-5-21-1-2-3": "S-1-5-21-7-8-9", "S-1-5-21-1-2-3-1104": "S-1-5-21-7-8-9-6", "S-1-5-32-544": "S-1-5-32-544"}
    assert saved["legacy_reverse_aliases"] == {"S-1-5-21-7-8-9-66": "S-1-5-21-1-2-3-1104-77"}
    ask = lambda table, name, f, v: [r[2] for r in f(table, spark.createDataFrame([(v,)], f"{name} string")).collect()]
    assert ask(mapping.reversals(spark, saved), "pseudonym", mapping.reverse, "s-1-5-21-7-8-9-66") == ["S-1-5-21-1-2-3-1104-77"]
    assert ask(mapping.from_map(spark, saved), "real", mapping.forward, "S-1-5-21-1-2-3-1104-77") == []
    text = spark.createDataFrame([("S-1-5-21-7-8-9-66 S-1-5-21-7-8-9-6",)], "text string")
    assert job.restore(spark, str(tmp_path / "m.json"), text).first().text == "S-1-5-21-1-2-3-1104-77 S-1-5-21-1-2-3-1104"
    assert load({"salt": SALT, "categories": {"sids": {"1-2-3": "x"}}})["categories"]["sids"] == {"1-2-3": "x"}
    alias = lambda fake, real: {"salt": SALT, "format_version": 2, "categories": {"sids": {"S-1-5-21-1-2-3-4": "S-1-5-21-7-8-9-5"}}, "legacy_reverse_aliases": {"sids": {fake: real}}}
    assert load(alias("S-1-5-21-7-8-9-6", "S-1-5-21-1-2-3-4-5"))["legacy_reverse_aliases"]
    deep = {**V1["categories"]["sids"], "S-1-5-21-1-2-3-1105-78": "S-1-5-21-4-5-66"}
    for bad in (
        alias("S-1-5-21-7-8-9", "S-1-5-21-1-2-3-4-5"), alias("S-1-5-21-7-8-9-6", "S-1-5-21-1-2-3-4"), alias("S-1-5-21-7-8-9-06", "S-1-5-21-1-2-3-4-5"), alias("S-1-5-21-7-8-9-5", "S-1-5-21-1-2-3-4-5"),
        {"salt": SALT, "legacy_reverse_aliases": {"hosts": {"a": "b"}}}, {"salt": SALT, "categories": {"what": {}}}, {"salt": SALT, "format_version": 3}, {"categories": {}}, {"salt": SALT, "categories": {"sids": deep}},
    ):
        with pytest.raises(publish.PublishError):
            load(bad)
    with pytest.raises(mapping.MappingError):
        mapping.check_reuse(spark.createDataFrame([("sids", "s-1-5-21-7-8-9-66")], "category string, pseudonym_norm string"), saved)


def test_fingerprint_ignores_order(spark, run):
    from veilgraph.operators import mapping

    first = mapping.fingerprint(run.registry)
    assert first[0] == run.registry.count() and mapping.fingerprint(run.registry.repartition(5).orderBy(F.desc("norm"))) == first
    assert mapping.fingerprint(run.registry.withColumn("pseudonym", F.concat("pseudonym", F.lit("x")))) != first


def test_command_line(spark, folder, tmp_path, capsys):
    from veilgraph.__main__ import main

    out, map_ = str(tmp_path / "out.zip"), str(tmp_path / "map.json")
    assert main(["anonymize", "--input", str(folder), "--out", out, "--map", map_, "--salt", SALT, "--no-summary"]) == 0
    assert json.loads(capsys.readouterr().out)["object_classifications"]
    assert main(["inspect", "--input", str(folder), "--no-progress"]) == 0 and "objects: " in capsys.readouterr().out
    fake = publish.load_mapping(map_)["categories"]["accounts"]["zqalice"]
    assert main(["restore", "--map", map_, "--lookup", fake]) == 0 and "accounts\tzqalice" in capsys.readouterr().out
    (tmp_path / "t.txt").write_text("ask ZQAlice")
    assert main(["scrub", "--map", map_, "--input", str(tmp_path / "t.txt"), "--summary"]) == 0
    got = capsys.readouterr()
    assert got.out == f"ask {fake}" and "accounts" in got.err and "unresolved: 0" in got.err
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"meta": {"type": "users", "count": 5}, "data": []}))
    assert main(["anonymize", "--input", str(bad), "--out", str(tmp_path / "no"), "--verbose-failures"]) == 1
    assert "source-invalid-meta-count" in capsys.readouterr().err
    assert main(["anonymize", "--input", str(folder), "--out", out]) == 2


def test_members_that_are_no_files_or_change(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOCS["b.json"]))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "b.json").write_text(json.dumps(DOCS["a.json"]))
    os.symlink(tmp_path / "other", tmp_path / "in" / "linked")
    assert collection.read_members(spark, str(tmp_path / "in")).count() == 1
    before = collection.listing(spark, str(tmp_path / "in" / "a.json"))
    collection.check_unchanged(spark, str(tmp_path / "in" / "a.json"), before)
    (tmp_path / "in" / "a.json").write_text("{}")
    with pytest.raises(collection.CollectionError, match="changed"):
        collection.check_unchanged(spark, str(tmp_path / "in" / "a.json"), before)
    os.symlink(tmp_path / "other" / "b.json", tmp_path / "in" / "c.json")
    with pytest.raises(collection.CollectionError, match="non-regular"):
        collection.read_members(spark, str(tmp_path / "in"))


def test_a_taken_name_is_never_replaced(tmp_path):
    for kind in ("folder", "file"):
        staged, out = tmp_path / f"{kind}.staging", tmp_path / kind
        out.mkdir()
        staged.mkdir() if kind == "folder" else staged.write_text("new")
        with pytest.raises(publish.PublishError):
            publish.rename_new(str(staged), str(out))
        assert staged.exists() and os.listdir(out) == []
    publish.rename_new(str(tmp_path / "folder.staging"), str(tmp_path / "fresh"))
    assert (tmp_path / "fresh").is_dir() and not (tmp_path / "folder.staging").exists()


def test_own_rules_keep_names_within_a_distinguished_name(spark, tmp_path):
    own = [r for r in tables.rules() if not (r.path == "Properties.name" and "*" in r.node_types)] + [tables.Rule("own.name", "Properties.name", "parse_dn")]
    items = [{"ObjectIdentifier": "cccccccc-1111-2222-3333-444444444444", "Properties": {"name": n, "wkguid": "AA312825768811D1ADED00C04FD8D5CD"}} for n in ("CN=Computers,DC=zqcorp,DC=local", "CN=zqbox,DC=zqcorp,DC=local")]
    (tmp_path / "a.json").write_text(json.dumps(doc("containers", items)))
    run = job.transform(collection.read_members(spark, str(tmp_path / "a.json")), SALT, own_rules=own)
    names = [o["Properties"]["name"] for o in json.loads(run.documents().first().body)["data"]]
    assert names[0].startswith("CN=Computers,DC=") and names[0].endswith(",DC=local") and "zq" not in "".join(names).lower() and run.findings.isEmpty()


def test_real_tokens(spark, run):
    got = [r.real for r in mapping.real_tokens(run.registry, {"legacy_reverse_aliases": {"S-1-5-21-9-9-9-1": "S-1-5-21-1-2-3-4-5"}}).collect()]
    assert got == sorted(got) and len(got) == len(set(got)) and "S-1-5-21-1-2-3-4-5" in got and set(got) >= {r.real for r in run.registry.collect()}
    assert [g.gate for g in verify.by_gate(spark.createDataFrame([(g, "m", "p", "c", None) for g in ("records", "evidence", "source")], "gate string, member string, path string, code string, offender string")).collect()] == ["source", "evidence", "records"]


def test_clock():
    from veilgraph.__main__ import clock

    assert [clock(s) for s in (0, 41.9, 72, 3600)] == ["0:00", "0:41", "1:12", "60:00"]
