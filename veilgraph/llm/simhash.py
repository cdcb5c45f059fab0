"""op3: SimHash fingerprints and exact linking by multi-index hashing.

Fingerprints are cut in segments with a radius each, so that two at 4 or fewer differing bits agree in one segment at least to within
its radius: the radii and one for each segment sum up to 5. Each fingerprint is entered in a table under its segment values and probes it with the Hamming
balls of those radii. Of two values some bits apart exactly one has a 0 at the lowest of them, so only flips that begin with a 0 are enumerated. What
meets is verified on all 64 bits. How many segments is chosen by the number of distinct fingerprints, for the least probes and
expected meetings: wide segments with larger balls for many, narrow ones for few.

Equal fingerprints are one entry, so exact copies cost nothing; fingerprints that share all but one nibble are linked
beforehand, in proportion to their number, and pairs already in one component aren't made again. A segment value that many fingerprints share is dealt to
several tasks by hash of the fingerprint, and its probes go to each of them.

A text without words (null, empty, blank) has the zero fingerprint, linked like any other; texts of any length go through whole. Rows of equal doc_id stay rows; a row
whose doc_id is null gets the component of its fingerprint, null if nothing with a doc_id is linked to it. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, attach, connected_components, materialize, release, schema, table

SHINGLE, SEED, DISTANCE = 4, 42, 4
CHUNK = 1 << 15
#: Fingerprints under one segment value that a task takes.
SHARE = 2048


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        own = words[at : at + CHUNK + SHINGLE - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(own, own[1:], own[2:], own[3:])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        got = np.array([fingerprint(t.as_py()) for t in batch.column(0)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got.view(np.int64))], names=[*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, the long columns in ``keep`` and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col("text").cast("string").alias("_judged"), F.col("doc_id").cast("long"), *keep)
    return rows.mapInArrow(_fingerprints, schema(doc_id=LONG, **dict.fromkeys(keep, LONG), fp=LONG))


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def nibble_links(prints: DataFrame) -> DataFrame:
    """Edges a, b between fingerprints (column fp with node id) that differ in one nibble at most: each to the least of its group."""
    masked = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(~(15 << 4 * k) if k < 15 else (1 << 60) - 1)).alias("rest")) for k in range(16)])
    keyed = prints.select("node", F.explode(masked).alias("m")).select("node", "m.k", "m.rest")
    least = keyed.groupBy("k", "rest").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("k", "rest", "least")
    return keyed.join(least, ["k", "rest"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def segments(n: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """First bit, width and radius of each segment, for n distinct fingerprints: the cheapest number of segments by probes and expected meetings."""

    def cut(m: int) -> list[tuple[int, int, int]]:
        out, first = [], 0
        for k in range(m):
            width = (64 - first) // (m - k) + (1 if (64 - first) % (m - k) else 0)
            out.append((first, width, (distance + 1) // m + (k < (distance + 1) % m) - 1))
            first += width
        return out

    def cost(m: int) -> float:
        balls = [(sum(math.comb(w, r) for r in range(radius + 1)), w) for _, w, radius in cut(m)]
        return sum(1 + (ball - 1) / 2 + n * ball / 2.0**w / 2 for ball, w in balls)

    return cut(min(range(2, distance + 2), key=cost))


def _ball(key: Column, width: int, radius: int) -> Column:
    """The keys within ``radius`` of key, but for itself and those whose own balls hold it: the lowest bit that differs is 0 in key."""
    masks = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m & -m).cast("long").alias("low")) for m in masks])
    return F.transform(F.filter(flips, lambda f: key.bitwiseAND(f["low"]) == 0), lambda f: key.bitwiseXOR(f["m"]))


def ball_links(prints: DataFrame, cuts: list[tuple[int, int, int]], distance: int = DISTANCE) -> DataFrame:
    """Edges a, b between components of fingerprints (node, fp, component) at ``distance`` or fewer bits that aren't in one component yet."""
    entries, probes = [], []
    for s, (first, width, radius) in enumerate(cuts):
        entries.append(_segment(F.col("fp"), first, width).bitwiseOR(F.lit(s << 40)))
        probes.append(F.array(entries[-1]))
        if radius:
            probes.append(_ball(entries[-1], width, radius))
    entry = prints.select(F.explode(F.array(*entries)).alias("key"), F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("component").alias("cb"))
    probe = prints.select(F.explode(F.flatten(F.array(*probes))).alias("key"), F.col("node").alias("a"), F.col("fp").alias("fp_a"), F.col("component").alias("ca"))
    # values that over SHARE fingerprints have, and into how many shares they are cut
    full = materialize(entry.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {SHARE}").select("key", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "full")
    entry = entry.join(full, "key", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("b", F.lit(6)), F.col("shares")).cast("int"), F.lit(0))).drop("shares")
    probe = probe.join(full, "key", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares") - 1, F.lit(0))))).drop("shares")
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance
    met = probe.join(entry, (probe.key == entry.key) & (probe.share == entry.share) & (F.col("ca") != F.col("cb")) & near)
    return met.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def components(prints: DataFrame) -> DataFrame:
    """prints: (doc_id, fp). Returns for each distinct fingerprint fp, its number of rows m, its component's number (part) and least doc_id (component_id)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    first = connected_components(nibble_links(nodes))
    placed = nodes.join(first.withColumnRenamed("component", "near"), "node", "left").select("fp", "node", "least", "m", F.coalesce("near", "node").alias("component"))
    placed = materialize(placed, "placed")
    second = connected_components(ball_links(placed, segments(nodes.count()))).select(F.col("node").alias("component"), F.col("component").alias("wide"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("least")).join(second, "component", "left").withColumn("wide", F.coalesce("wide", "component"))
    least = sizes.groupBy("wide").agg(F.min("least").alias("component_id"))
    ids = materialize(sizes.join(least, "wide").select("component", "n", F.col("wide").alias("part"), "component_id"), "components")
    known = attach(placed.select("fp", "node", "m", "component"), ids, ["component"], "n", "node")
    return materialize(known.select("fp", "m", "part", "component_id"), "known")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    prints = materialize(fingerprints(docs), "fingerprints")
    return attach(prints, components(prints), ["fp"], "m", "doc_id").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of its least doc_id, rows without one last; of several texts under that id the one of least
    fingerprint and hash; of equal rows any one."""
    names = {c.lower() for c in docs.columns}
    h1, h2 = (next(f"{x}{k}" for k in count() if f"{x}{k}" not in names) for x in ("_first", "_second"))
    own = docs.withColumn(h1, F.xxhash64(F.col("text").cast("string"))).withColumn(h2, F.xxhash64(F.lit(1), F.col("text").cast("string")))
    prints = materialize(fingerprints(own, [h1, h2]), "fingerprints")
    texts = prints.groupBy("doc_id", "fp", h1, h2).agg(F.count("*").alias("n"))
    named = materialize(attach(texts, components(prints.select("doc_id", "fp")), ["fp"], "m", h1), "named")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", h1, h2)
    firsts = materialize(named.groupBy("part").agg(F.min(key).alias("first"), F.count("*").alias("texts")), "firsts")
    placed = materialize(attach(named, firsts, ["part"], "texts", h1).select("doc_id", h1, h2, "n", key.eqNullSafe(F.col("first")).alias("stays")), "placed")

    def these(rows: DataFrame, condition: str, how: str) -> DataFrame:
        some = placed.where(condition).select("doc_id", h1, h2)
        return rows.join(some, rows["doc_id"].cast("long").eqNullSafe(some["doc_id"]) & (rows[h1] == some[h1]) & (rows[h2] == some[h2]), how)

    left = these(own, "not stays", "left_anti")
    if not placed.where("stays and n > 1").isEmpty():  # rows that repeat in id and text
        again = these(left, "stays and n > 1", "left_semi").dropDuplicates(["doc_id", h1, h2])
        left = these(left, "stays and n > 1", "left_anti").union(again)
    return left.select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
