"""op6 and op8 against brute force."""

import collections
import math
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilgraph.llm import ann, common, embed_dedup, vectors as vectors_

SF, SCHEMA = "/root/testdata/sf0.1", "vec_id long, embedding array<float>, label int, node string"


def least_reachable(n, links):
    own = list(range(n))
    while True:
        before = list(own)
        for a, b in links:
            own[a] = own[b] = min(own[a], own[b])
        if own == before:
            return own


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1, None):
        centers = r.normal(size=(25, 16))
        for c in centers:
            for _ in range(r.integers(1, 12)):
                rows.append((n, [float(x) for x in np.float32(c + r.normal(size=16) * 0.12)], label, "x"))
                n += 1
    rows += [(n + k, rows[3][1], 0, "copy") for k in range(30)]
    n += 30
    rows += [(n, None, 0, ""), (n + 1, [0.0] * 16, 0, ""), (n + 2, [float("nan")] * 16, 0, ""), (n + 3, [], 0, ""), (n + 4, [None] * 16, 1, ""), (n + 5, [1.0, -0.0], 1, ""), (n + 6, [1.0, 0.0], 1, ""), (n + 7, [2.0, 0.1], 1, ""), (n + 8, [1.0], 1, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def wanted_links(frame):
    """n_links and the least linked row of each row of a frame, by comparing all pairs."""
    n = len(frame)
    link = np.zeros((n, n), bool)
    rows = list(zip(frame.embedding, frame.label))
    for dim in {len(v) for v, _ in rows if sound(v)}:
        at = [k for k, (v, lab) in enumerate(rows) if sound(v) and len(v) == dim and not pd.isna(lab)]
        if at:
            u = np.array([np.array(rows[k][0], float) for k in at])
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            lab = np.array([rows[k][1] for k in at])
            link[np.ix_(at, at)] = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    return link.sum(1), least_reachable(n, np.argwhere(link))


def check_links(frame, got):
    """frame in the order of rows that got should have; ids may repeat or be null."""
    n, root = wanted_links(frame)
    ids = [None if pd.isna(i) else int(i) for i in frame.vec_id]
    least = {}
    for i, c in zip(ids, root):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    want = collections.Counter((i, int(k), least[c], i is not None and i == least[c]) for i, k, c in zip(ids, n, root))
    none = lambda x: None if pd.isna(x) else int(x)
    assert collections.Counter((none(r.vec_id), int(r.n_links), none(r.component_id), bool(r.kept)) for r in got.itertuples()) == want


def test_op6_equals_brute_force(vectors):
    check_links(vectors.toPandas(), embed_dedup.near_duplicates(vectors).toPandas())
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0
    assert embed_dedup.near_duplicates(vectors.where("embedding is null")).toPandas().n_links.tolist() == [0]


def test_op6_query_equals_brute_force(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = embed_dedup.op6_multi_index(spark, SF).toPandas()
    check_links(d, got)


def test_op6_repeated_and_null_ids(spark):
    one, other = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    rows = [(5, one, 0, ""), (5, other, 0, ""), (6, one, 0, ""), (4, one, 0, ""), (5, one, None, ""), (None, other, 0, ""), (None, [0.5] * 8, 0, ""), (7, [0.0] * 8, 0, ""), (5, one, 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    check_links(pd.DataFrame(rows, columns=["vec_id", "embedding", "label", "node"]).astype({"vec_id": "Int64", "label": "Int64"}), embed_dedup.near_duplicates(frame).toPandas())


def linked_pair(r, d, cosine):
    """Two unit vectors at a cosine; their difference lies along one coordinate as far as it can."""
    a = r.normal(size=d)
    a /= np.linalg.norm(a)
    b = np.eye(d)[r.integers(d)]
    b -= a * (a @ b)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b / np.linalg.norm(b)


def links_of(spark, x, label=0):
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": label})
    return embed_dedup.near_duplicates(spark.createDataFrame(frame)).toPandas().sort_values("vec_id")


def test_op6_links_beside_a_hot_group(spark):
    r = np.random.default_rng(6)
    hot = r.normal(size=16) + r.normal(size=(2000, 16)) * 1e-3
    rest = [v for _ in range(1500) for v in linked_pair(r, 16, 0.935)]
    x = np.concatenate([hot, rest])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    np.fill_diagonal(link, False)
    got = links_of(spark, x)
    assert list(got.n_links) == list(link.sum(1))
    pairs = [(0, k) for k in range(2000)] + [(a, b) for a, b in np.argwhere(link) if b >= 2000]  # the hot ones are all linked
    assert link[:2000, :2000].sum() == 2000 * 1999 and list(got.component_id) == least_reachable(len(x), pairs)


def test_op6_rare_links_and_a_dominating_label(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(20_000, 20)), [v for _ in range(40) for v in linked_pair(r, 20, 0.931)]])
    label = np.where(np.arange(len(x)) % 50 == 0, np.arange(len(x)) % 40, 99)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = np.concatenate([np.argwhere((u[k : k + 2000] @ u.T >= 0.93) & (label[k : k + 2000, None] == label)) + [k, 0] for k in range(0, len(u), 2000)])
    link = link[link[:, 0] != link[:, 1]]
    got = links_of(spark, x, label)
    assert list(got.n_links) == list(np.bincount(link[:, 0], minlength=len(x))) and got.n_links.sum() >= 60
    assert list(got.component_id) == least_reachable(len(x), link)


def check_answers(frame, got, asked, k=10, share=1.0):
    """Complete ranks, exact scores and the share of true neighbours; ids don't repeat here."""
    rows = [(i, np.array(v, float)) for i, v in zip(frame.vec_id, frame.embedding) if sound(v) and not pd.isna(i)]
    hit = total = 0
    byq = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    for q, v in rows:
        if not asked(q):
            assert q not in byq
            continue
        near = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, w in rows if len(w) == len(v) and i != q)
        far = dict((i, s) for s, i in near)
        want = near[:k]
        if not want:
            assert q not in byq
            continue
        g = byq[q]
        assert list(g["rank"]) == list(range(1, len(want) + 1)), (q, len(g), len(want))
        assert np.allclose(g.score, [far[i] for i in g.vec_id], rtol=1e-12, atol=0) and list(g.score) == sorted(g.score)
        assert all(a.vec_id < b.vec_id for a, b in zip(g.itertuples(), list(g.itertuples())[1:]) if a.score == b.score)
        hit, total = hit + sum(s <= want[-1][0] * (1 + 1e-12) for s in g.score), total + len(want)
    assert hit >= share * total
    return hit / max(1, total)


def test_op8_equals_brute_force_on_few_vectors(vectors):
    frame = vectors.toPandas()
    check_answers(frame, ann.search(vectors, F.expr("vec_id % 20 = 0")).toPandas(), lambda q: q % 20 == 0, share=0.95)
    check_answers(frame, ann.exact(vectors, F.expr("vec_id % 20 = 0")).toPandas(), lambda q: q % 20 == 0)
    assert ann.search(vectors.limit(0), F.lit(True)).count() == 0


def test_op8_query(spark):
    frame = pd.read_parquet(f"{SF}/embeddings.parquet")
    check_answers(frame, ann.op8_ivfpq(spark, SF).toPandas(), lambda q: q % 100 == 0, share=0.9)


@pytest.mark.parametrize("n", [1, 2, 5, 11, 12, 60, 200])
def test_op8_answers_are_complete(spark, n):
    """Two scales and copies: a query whose nearest lists hold few vectors goes on to others."""
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 8)) * np.where(np.arange(n) % 2, 20.0, 1.0)[:, None]
    if n > 20:
        x[5:20] = x[4]
    frame = pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist(), "label": 0})
    check_answers(frame, ann.search(spark.createDataFrame(frame), F.lit(True)).toPandas(), lambda q: True, share=0.9)


def test_op8_repeated_and_null_ids(spark):
    rows = [(100, [float(k), 0.5], 0, "") for k in range(14)] + [(None, [3.0, 0.5], 0, ""), (7, [2.0, 0.5], 0, ""), (7, [2.0, 0.5], 0, "")]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 100).toPandas()
    assert len(got) == 14 * 10 and (got.groupby("rank").size() == 14).all() and set(got.query_id) == {100}
    at_two = got[(got.vec_id == 7) & (got.score == 0)]
    assert sorted(at_two["rank"]) == [1, 2]  # the one row at (2, 0.5) meets both rows of id 7, never itself


def test_op8_visits_of_a_hot_group():
    r = np.random.default_rng(3)
    c = r.normal(size=(200, 32))
    hot = c[0] + r.normal(size=(10_000, 32)) * 0.02
    x = np.concatenate([hot, c[r.integers(200, size=20_000)] + r.normal(size=(20_000, 32)) * 0.3])
    index = ann.Index(x[r.permutation(len(x))[: ann.SAMPLE]], len(x), 10)
    own = index.encode(x)[0]
    index.store(collections.Counter(own.tolist()), 4096)
    for asked in (np.arange(0, 10_000, 100), np.arange(10_000, 30_000, 200)):
        batch = pa.RecordBatch.from_arrays([pa.array(asked), pa.array(list(x[asked]))], names=["query", "embedding"])
        visits = collections.defaultdict(set)
        for q, lists in ((q, y) for b in ann._route(types.SimpleNamespace(value=index), 1, 11)([batch]) for q, y in zip(*(b.column(c).to_pylist() for c in ("query", "lists")))):
            visits[q].update(lists)
        near = [np.argsort(((x - x[q]) ** 2).sum(1))[1:11] for q in asked]
        assert sum(own[n] in visits[q] for q, ns in zip(asked, near) for n in ns) >= 0.95 * 10 * len(asked)


def test_op8_recall_is_measured_and_widened(spark):
    """Without structure the visits fitted on the sample are not enough for the target; the search widens until they are."""
    r = np.random.default_rng(8)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(3000), "embedding": r.normal(size=(3000, 24)).tolist()}))
    rows = common.materialize(vectors_.usable(frame).withColumn("row", F.col("vec_id")), "t")
    found = ann.Searcher(rows, 10, 1.0)
    assert found.recall == 1.0 and found.widen > 1


def test_attach_salts_hot_keys(spark):
    rows = spark.range(20_000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    right = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    got = common.attach(rows, right, ["key"], "size", "n")
    assert got.count() == 20_000 and got.where("least is null or least <> key").count() == 0
