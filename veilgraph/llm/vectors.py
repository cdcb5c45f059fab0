"""Vectors: which take part, bounded samples, k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element_kind(vectors: DataFrame) -> str:
    """The type vectors are shipped as: single precision stays, everything else becomes double."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    return kind if kind in ("array<float>", "array<double>") else "array<double>"


def takes_part() -> Column:
    """Whether the embedding is neither null nor zero and holds only finite numbers; never null."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that take part, with their length ``dim``. Negative zeros become zeros."""
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    return vectors.where(takes_part()).withColumn("embedding", plain).withColumn("dim", F.size("embedding"))


def lengths(rows: DataFrame) -> list[int]:
    """The distinct lengths, shortest first: one number for each."""
    return sorted(r.dim for r in rows.select("dim").distinct().collect())


def matrix(column: pa.Array) -> np.ndarray:
    """A float64 matrix of an Arrow column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # very small or large components
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def by_hash() -> list[Column]:
    """An order of classes that depends on nothing but their vectors."""
    return [F.xxhash64("embedding"), F.col("embedding")]


def sample(classes: DataFrame, n: int) -> np.ndarray:
    """The n vectors of least hash."""
    return matrix(classes.orderBy(*by_hash()).limit(n).select("embedding").toArrow().column(0))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(1) - 2 * (x @ centers.T), axis=1)


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centers of the rows of x."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        own = np.concatenate([nearest(x[a : a + 4096], centers) for a in range(0, len(x), 4096)])
        sums, counts = np.zeros_like(centers), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return centers
