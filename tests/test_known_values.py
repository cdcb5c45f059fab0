"""The engine against known values."""

import json
import os
import zipfile

import known_values
import pytest
from pyspark.sql import functions as F

from veilgraph.functions import pieces
from veilgraph.operators import audit, decide, mapping, textops
from veilgraph.plans import adapter, job
from veilgraph.sources import collection


def shown(own):
    return "".join(t if c is None else f"-SA<{t}>" if c == "arc" else "-" + t.rpartition("-")[2] if c == "kept_arc" else f"M<{c}|{t}>" for c, t in own)


@pytest.mark.parametrize("form, value, keep, want", known_values.PIECES)
def test_pieces(form, value, keep, want):
    own = pieces.token(value, keep) if form == "token" else mapping.cut(form, value, None, keep)
    assert shown(own) == want


def test_name_parts_that_stay():
    kept = {("CN", "Domain Admins"), ("CN", "Users"), ("OU", "Research")}
    own = lambda v: shown(pieces.dn(v, lambda kind, text: (kind, text) in kept))
    assert own("CN=Domain Admins,CN=Users,DC=acme,DC=local") == "CN=Domain Admins,CN=Users,DC=M<domains|acme>,DC=local"
    assert own("CN=Alice,OU=Research,DC=acme,UID=42,DC=local") == "CN=M<accounts|Alice>,OU=Research,DC=M<domains|acme>,UID=M<opaque|42>,DC=local"


def test_spellings_and_sweeps():
    for text, signature, spelling in known_values.SPELLINGS:
        assert list(textops.signature(text)) == signature and textops.one_spelling(text) == spelling
    for texts, want in known_values.DISTINCT:
        assert textops.distinct_ignoring_case(texts) == want
    for tokens, pattern, texts in known_values.SWEEPS:
        assert textops.token_pattern(list(tokens)).pattern == pattern
        for text, found, swept in texts:
            assert sorted(textops.find_tokens(text, list(tokens))) == found and textops.sweep(text, tokens) == swept


def test_characters_match_as_the_regular_expression_engine_has_it():
    import re

    chars = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x1E9E, 0x1FD3, 0x1FE3, 0x212A, 0x212B, 0xFB05, 0xFB06]]
    every = "".join(chars)
    for c in chars:
        assert {x for x in chars if textops.match_ignoring_case(c, x)} == set(re.findall(re.escape(c), every, re.I)), c


def test_factored_patterns_find_the_same():
    import random
    import re

    r = random.Random(1)
    for _ in range(300):
        words = sorted({"".join(r.choice("abc. ") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))}, key=lambda w: (-len(w), w))
        text = "".join(r.choice("abc. ") for _ in range(60))
        assert re.findall(textops.factored(words).replace("(?:", "(?:"), text) == re.findall("|".join(map(re.escape, words)), text), words
    many = [chr(0x4E00 + k) + "x" for k in range(100)]
    assert textops.factored(many) == "(?:" + "|".join(many) + ")"


@pytest.fixture(scope="module")
def known_run(spark):
    rows = [(f"member-{k:05}.json", bytearray(text.encode())) for k, (_, text, _) in enumerate(known_values.DOCUMENTS, 1)]
    return job.transform(spark.createDataFrame(rows, "member string, raw binary"), known_values.SALT)


def test_documents(known_run):
    got = {r.member: r.body for r in known_run.documents().collect()}
    assert [got[f"member-{k:05}.json"] for k in range(1, len(got) + 1)] == [want for *_, want in known_values.DOCUMENTS]
    assert known_run.findings.isEmpty()


def test_audit(known_run):
    assert audit.summary(known_run.audit()) == known_values.AUDIT


def test_many_targets_are_joined_as_few_are(spark, monkeypatch):
    nation = F.col("n_nationkey")
    sf = "/root/testdata/sf0.001"
    rids = adapter.table(spark, sf, "nation").select(F.concat(adapter.domain_sid(nation), F.lit("-513")).alias("sid"), F.lit("e").alias("entry_id"))
    token = F.when(F.col("c_custkey") % 5 == 0, "no sid").otherwise(F.concat(adapter.domain_sid(F.col("c_nationkey")), F.lit("-513")))
    rows = adapter.table(spark, sf, "customer").select(F.lit("m").alias("member"), F.col("c_custkey").cast("string").alias("record"), token.alias("token"))
    few = {(r.record, r._rid) for r in decide.with_evidence(rows, rids).select("record", "_rid").collect()}
    monkeypatch.setattr(decide, "FEW_RIDS", -1)
    assert {(r.record, r._rid) for r in decide.with_evidence(rows, rids).select("record", "_rid").collect()} == few and len(few) == rows.count()


def test_damaged_mappings_are_refused(spark, tmp_path):
    from veilgraph.__main__ import main

    schema = "category string, norm string, pseudonym_norm string"
    sound = [("sids", "s-1-5-21-1-2-3", "s-1-5-21-7-8-9"), ("sids", "s-1-5-21-1-2-3-1104", "s-1-5-21-7-8-9-5"), ("sids", "s-1-5-32-544", "s-1-5-21-4-4-4"), ("sids", "s-1-5-21-5-6-7-8-9", "s-1-5-21-1-1-1-2-3")]
    mapping.check_hierarchy(spark.createDataFrame(sound, schema))
    for bad in (("sids", "s-1-5-21-1-2-3-1105", "s-1-5-21-7-8-8-6"), ("sids", "s-1-5-21-1-2-3-1105", "s-1-5-21-7-8-9")):
        with pytest.raises(mapping.MappingError):
            mapping.check_hierarchy(spark.createDataFrame([*sound, bad], schema))
    (tmp_path / "in.json").write_text(json.dumps({"meta": {"type": "users", "count": 1}, "data": [{"ObjectIdentifier": "S-1-5-21-1-2-3-1104"}]}))
    saved = {"salt": known_values.SALT, "format_version": 2, "policy": {"catalog_version": 2}, "categories": {"sids": {"S-1-5-21-1-2-3": "S-1-5-21-7-8-9", "S-1-5-21-1-2-3-1104": "S-1-5-21-9-9-9-5"}}}
    (tmp_path / "map.json").write_text(json.dumps(saved))
    assert main(["anonymize", "--input", str(tmp_path / "in.json"), "--out", str(tmp_path / "out"), "--reuse-map", str(tmp_path / "map.json")]) == 2
    assert not (tmp_path / "out").exists()


def test_refusals(spark, tmp_path, capsys):
    from veilgraph.__main__ import main

    good = json.dumps({"meta": {"type": "users", "count": 0}, "data": []})

    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    def archive(name, *items):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in items:
                z.writestr(n, d)
        return str(tmp_path / name)

    cut = archive("cut.zip", ("a.json", good * 50))
    with open(cut, "r+b") as f:
        f.truncate(os.path.getsize(cut) - 30)
    hurt = archive("hurt.zip", ("a.json", "".join(chr(33 + k * k % 90) for k in range(4000))))
    with open(hurt, "r+b") as f:
        f.seek(60)
        f.write(b"\xff" * 40)
    nested = archive("n.zip", ("a.json", json.dumps({"meta": {"type": "users", "count": 1}, "data": [5]})))
    for bad, says in (
        (file("a.json", "[]"), "File is not a zip file"), (file("b.json", "prose"), "File is not a zip file"), (file("c.json", ""), "File is not a zip file"),
        (file("d.json", json.dumps({"meta": {"type": "users", "count": 2}, "data": [{}, 5]})), "member-00001.json: data item 1 is not an object"), (nested, "data item 0 is not an object"),
        (archive("u.zip", ("../x.json", good)), "unsafe member name"), (cut, "File is not a zip file"), (hurt, "can't be read"), (str(tmp_path / "none"), "input does not exist"),
        (archive("e.zip", ("x.txt", "no")), "no member"),
    ):
        for verb in (["anonymize", "--out", str(tmp_path / "out.zip")], ["inspect"]) if "data item" not in says and "no member" not in says else (["anonymize", "--out", str(tmp_path / "out.zip")],):
            assert main([verb[0], "--input", bad, *verb[1:]]) == 2, (bad, verb)
            err = capsys.readouterr().err
            assert says in err and "Traceback" not in err and len(err.splitlines()) == 1, err
    assert not (tmp_path / "out.zip").exists()


def test_hash_of_an_archive_is_its_bytes(spark, tmp_path):
    import hashlib

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.json", json.dumps({"meta": {"type": "users", "count": 0}, "data": []}))
    members = collection.read_members(spark, str(path))
    assert collection.source_hash(spark, str(path), members) == hashlib.sha256(path.read_bytes()).hexdigest() != collection.input_hash(members)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"meta": {"type": "users", "version": 5, "count": 0}, "data": []}))
    (tmp_path / "d" / "b.json").write_text(json.dumps({"meta": {"type": "users", "version": 6, "count": 0}, "data": []}))
    (tmp_path / "d" / "c.json").write_text("[1]")
    report = job.inspect(spark, str(tmp_path / "d"))
    assert [m["member"] for m in report["skipped"]] == ["member-00003.json"] and [t["version"] for t in report["types"]] == ["5", "6"] and report["more_unknown_paths"] == 0
