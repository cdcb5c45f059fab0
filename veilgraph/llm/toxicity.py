"""op2: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of a text's distinct words (spaces mark a word's ends), present or absent, each
scaled by log((1 + toxic texts with it) / all) - log((1 + other texts with it) / all), both over the sample (Wang and Manning, 2012);
a logistic regression weighs them. Fitting uses a bounded sample of labelled rows and keeps the n-grams whose ratio
stands out of chance. Scoring reads whole texts.

Null and empty texts get the score of a text without features, and so does every text if no n-gram stands out (few labelled rows): as classes weigh alike that is one half, not
toxic. If the labels hold only one class, or none, the score is that class's share (0 without labels). Of repeated labels for a document, toxic wins; of several texts under one
labelled doc_id the smallest is learned from. Labels other than 0 and 1 are ignored. Repeated rows are answered each; a null doc_id isn't learned from and its held_out is null.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOUBLE, INT, LONG, STRING, crc_mod, hold, materialize, release, schema, table

LENGTHS = (3, 4, 5)
#: Fitting, as defaults of ``fit``: at most so many labelled rows of each class, so many n-grams; least texts with an n-gram and least z-value of its ratio.
SAMPLE_TOXIC, SAMPLE_OTHER, FEATURES, LEAST_TEXTS, LEAST_Z = 3000, 5000, 20_000, 5, 4.0
STEPS, RIDGE = 300, 0.02
CUT = 0.7
#: Distinct words that a worker remembers.
WORDS = 300_000


def grams(word: str) -> set[str]:
    word = f" {word} "
    return {word[k : k + n] for n in LENGTHS for k in range(len(word) - n + 1)}


def text_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.key = weights, bias, uuid.uuid4().hex


class Scorer(dict):
    """word -> the model's n-grams in it (None: none), as the model's own strings: copies would take most of the memory."""

    def __init__(self, model: Model):
        self.model, self.own = model, {g: g for g in model.weights}

    def __missing__(self, word: str):
        if len(self) >= WORDS:
            self.clear()
        got = self[word] = tuple(filter(None, map(self.own.get, grams(word)))) or None
        return got

    def score(self, text: str | None) -> float:
        found = set()
        for own in map(self.__getitem__, text_words(text)):
            if own:
                found.update(own)
        z = self.model.bias + sum(map(self.model.weights.__getitem__, sorted(found)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def sample_ids(docs: DataFrame, labels: DataFrame, most_toxic: int, most_other: int) -> DataFrame:
    """doc_id, toxic: at most so many labelled documents of each class, those of least hash."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.join(docs.where("text is not null").select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    pick = lambda toxic, n: own.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return pick(1, most_toxic).union(pick(0, most_other))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class with each n-gram, summed over the task."""
    release()
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            found = set()
            for w in text_words(text.as_py()):
                found |= grams(w)
            seen[toxic].update(found)
    every = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(every), 50_000):
        own = every[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([seen[0][g] for g in own], pa.int64()), pa.array([seen[1][g] for g in own], pa.int64())], names=["gram", "other", "toxic"])


def _features(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, at = Scorer(Model(dict.fromkeys(vocabulary, 0.0), 0.0)), {g: k for k, g in enumerate(vocabulary)}
        for batch in batches:
            rows = [sorted({at[g] for own in map(scorer.__getitem__, text_words(t.as_py())) if own for g in own}) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "toxic", "own"])

    return run


def regress(rows: list[list[int]], toxic: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on present features scaled by ratio, by accelerated gradient descent; classes weigh alike."""
    counts = np.array([len(r) for r in rows])
    owner, cols = np.repeat(np.arange(len(rows)), counts), np.array([c for r in rows for c in r], dtype=np.int64)
    values = ratio[cols]
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    norms = np.bincount(owner, values**2, len(rows)) + 1
    rate = 1 / (0.25 * float((share * norms).sum()) + RIDGE / len(rows))
    w, b = np.zeros(len(ratio)), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(STEPS):
        z = np.bincount(owner, values * vw[cols], len(rows)) + vb
        off = share * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - toxic)
        nw = vw - rate * (np.bincount(cols, off[owner] * values, len(ratio)) + RIDGE / len(rows) * vw)
        nb = vb - rate * off.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w * ratio, b


def sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, toxic, text: one row for each of the ids."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def ratios(counts: DataFrame, n0: int, n1: int, features: int, least_texts: int, least_z: float) -> list:
    """gram, ratio of at most ``features`` n-grams, the surest first. counts: gram, other, toxic, in parts."""
    p, q = (F.col("toxic") + 1) / (n1 + 2), (F.col("other") + 1) / (n0 + 2)
    ratio = F.log(p / q)
    z = F.abs(ratio) / F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("other") + 1))
    return (
        counts.groupBy("gram").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") + F.col("other") >= least_texts).select("gram", ratio.alias("ratio"), z.alias("z"))
        .where(F.col("z") >= least_z).orderBy(F.desc("z"), "gram").limit(features).collect()
    )


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = SAMPLE_TOXIC, most_other: int = SAMPLE_OTHER, features: int = FEATURES, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z) -> Model:
    spark = docs.sparkSession
    ids = sample_ids(docs, labels, most_toxic, most_other).collect()  # bounded: labelled ids are distinct
    n1 = sum(r.toxic for r in ids)
    n0 = len(ids) - n1
    if not n1 or not n0:
        return Model({}, 700.0 if n1 else -700.0)
    # an Arrow table becomes a local relation; a list would be an RDD, and executors would keep a second Python daemon for it
    chosen = spark.createDataFrame(pa.table({"doc_id": pa.array([r.doc_id for r in ids], pa.int64()), "toxic": pa.array([r.toxic for r in ids], pa.int32())}))
    rows = materialize(sampled(docs, chosen).repartition(max(6, spark.sparkContext.defaultParallelism), F.xxhash64("doc_id")), "labelled")
    counts = rows.select("text", "toxic").mapInArrow(_count, schema(gram=STRING, other=LONG, toxic=LONG))
    kept = ratios(counts, n0, n1, features, least_texts, least_z)
    vocabulary, scales = [r.gram for r in kept], np.array([r.ratio for r in kept])
    got = rows.select("doc_id", "toxic", "text").mapInArrow(_features(vocabulary), "doc_id long, toxic int, own array<int>").orderBy("doc_id").collect()
    w, b = regress([r.own for r in got], np.array([r.toxic for r in got]), scales)
    return Model(dict(zip(vocabulary, map(float, w))), float(b))


def scorer(model: Model) -> Scorer:
    """This worker's scorer of the model."""
    return hold(("toxicity", model.key), lambda: Scorer(model))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value).score
        for batch in batches:
            got = [score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64()), pa.array([int(s >= CUT) for s in got], pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with score and predicted."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_judged"))
    out = schema(**{f.name: f.dataType for f in rows.schema[:-1]}, score=DOUBLE, predicted=INT)
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), out)


def keeps(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        score = scorer(shared.value).score
        return pa.array([score(t.as_py()) < CUT for t in texts], pa.bool_())

    return docs.where(clean(F.col("text").cast("string")))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), 3) != 1)


def op2_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
