"""Mapping files that are larger than the driver should hold: written and read an item at a time."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from veilgraph.functions import jsontext
from veilgraph.functions.pseudonyms import CATEGORIES
from veilgraph.sources import collection, publish

POLICY = {"profile": "core", "catalog_version": 3, "preserve": True}


def odd(spark):
    r, chars = random.Random(1), 'aZ",:{}\\\n\r\x00 é￮\U0001f600ßz-. '
    rows = {(c, "".join(r.choice(chars) for _ in range(r.randint(0, 6)))) for c in ("sids", "accounts", "opaque") for _ in range(500)}
    return spark.createDataFrame([(c, t, f"x{t}") for c, t in rows], "category string, real string, pseudonym string").repartition(5)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("aliases", [None, {"S-1-5-21-1-2-3-4": "S-1-5-21-4-5-6-7-8"}])
def test_parts_are_the_whole_text_and_are_read_back(spark, tmp_path, empty, aliases):
    reg = odd(spark).where(F.lit(not empty))
    want = {c: {r.real: r.pseudonym for r in reg.collect() if r.category == c} for c in CATEGORIES}
    own = {"categories": want, "created": "now", "format_version": jsontext.Number(2), "input_hash": "h", "legacy_reverse_aliases": {"sids": aliases} if aliases else {}, "salt": "s"}
    own["policy"] = {"profile": "core", "catalog_version": jsontext.Number(3), "preserve": True}
    at = tmp_path / "m.json"
    publish._private(str(at), publish.mapping_parts(reg, "s", "h", POLICY, "now", aliases))
    assert at.read_bytes().decode() == jsontext.dumps(own, sort=True, indent=2)
    got = list(publish.saved_rows(str(at), 3))
    assert got == [(c, r, p) for c in sorted(want) for r, p in sorted(want[c].items())]
    assert publish.load_mapping(str(at), 3)["categories"] == want


def test_other_files_are_refused(spark, tmp_path):
    reg = odd(spark)
    for name, text, version in (("a", publish.mapping_text(reg, "s", "h", POLICY), 4), ("b", publish.mapping_text(reg, "s", "h"), 3), ("c", '{"categories": {}, "salt": "s"}', None)):
        (tmp_path / name).write_text(text)
        with pytest.raises(publish.PublishError):
            list(publish.saved_rows(str(tmp_path / name), version))
    with pytest.raises(publish.PublishError, match="unknown category"):
        publish.mapping_text(reg.withColumn("category", F.lit("zzz")), "s", "h")


def test_the_driver_holds_a_small_part(spark):
    rows = spark.range(600_000).select(F.lit("accounts").alias("category"), F.format_string("user%030d", "id").alias("real"), F.format_string("fake%030d", "id").alias("pseudonym"))
    tracemalloc.start()
    size = sum(map(len, publish.mapping_parts(rows, "s", "h")))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 49_000_000 and most < size / 2


def test_nothing_is_left_where_the_mapping_cant_be_written(tmp_path):
    def broken():
        yield "{"
        raise RuntimeError("lost")

    (tmp_path / "taken.json").write_text("kept")
    for at, parts, error in (("m.json", broken(), RuntimeError), ("taken.json", "text", publish.PublishError)):
        with pytest.raises(error):
            publish.publish([("a.json", "{}")], str(tmp_path / "out"), (str(tmp_path / at), parts))
    assert [p.name for p in tmp_path.iterdir()] == ["taken.json"] and (tmp_path / "taken.json").read_text() == "kept"


@pytest.mark.parametrize("n", [0, 1, 9, 200])
def test_members_come_in_turn(spark, n):
    rows = spark.range(n).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("member"), F.col("id").cast("string").alias("body")).repartition(3)
    assert [(r.member, r.body) for r in collection.in_turn(rows, "member", n)] == [(f"{k:05d}", str(k)) for k in range(n)]
