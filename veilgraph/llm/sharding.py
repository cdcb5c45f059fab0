"""op4: weighted rendezvous hashing of stable record keys to shards.

A record goes to the shard with the greatest -weight / ln(u), u being a hash of (key, shard number) in (0, 1).
Adding a shard changes no other shard's value, so records move only into the new one. The law is ``key``.

A null key is a key like any other; equal keys share a shard, so repeated rows do. Null texts have no bytes. Slots follow the order in which tasks read the
rows. Texts count by their bytes and may be of any length. Extra columns stay in ``shard`` and are ignored by op4. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import INT, LONG, STRING, materialize, release, schema, table, with_bases

SHARDS = 24


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard number (int) for a key."""
    tries = []
    for k, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("weights must be positive")
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(k), F.lit("shard")), 11).cast("double") + 0.5) / float(1 << 53)
        tries.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("s"), F.lit(k).alias("k")))
    return F.array_max(F.array(*tries))["k"].cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float]) -> DataFrame:
    """df with a column ``shard``."""
    return df.withColumn("shard", rendezvous(F.col(key), weights))


def write_shards(df: DataFrame, key: str, weights: Sequence[float], out: str, files: int = 1) -> None:
    """Write df with one folder a shard and about ``files`` files in each."""
    salt = F.pmod(F.xxhash64(F.col(key), F.lit("file")), F.lit(files))
    shard(df, key, weights).withColumn("_salt", salt).repartition(len(weights) * files, "shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(out)


PLACED = schema(doc_id=LONG, size=LONG, text_crc32=LONG, shard=INT, grown_shard=INT, part=INT, local=LONG)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each shard within a task."""
    release()
    part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        if len(shards):
            seen = np.pad(seen, (0, max(0, int(shards.max()) + 1 - len(seen))))
            order = np.argsort(shards, kind="stable")
            counts = np.bincount(shards, minlength=len(seen))
            local = np.empty(len(shards), np.int64)
            local[order] = np.arange(len(shards)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen = seen + counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shards), part, np.int32)), pa.array(local)], names=PLACED.names)


def number_slots(placed: DataFrame) -> DataFrame:
    """Gapless slots from 0 in each shard: a count within each task plus the counts of earlier tasks; no shard is gathered."""
    staged = materialize(placed.mapInArrow(_number, PLACED), "slots")
    counts = staged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    bases = with_bases(counts, ["shard"], "part", "n").select("shard", "part", "base")
    return staged.join(bases, ["shard", "part"]).withColumn("slot", F.col("base") + F.col("local")).drop("base", "local", "part")


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, data = table(spark, sf_dir, "documents"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        rendezvous(F.col("doc_id"), [1.0] * SHARDS).alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
    return number_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
