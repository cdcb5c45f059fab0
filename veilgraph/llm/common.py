"""Shared plumbing: tables in the shared folder, per-task numbering, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[object, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary folder of
    its own; on a cluster that would be a folder only one machine sees, so the call fails there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="veilgraph-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, tag: str) -> str:
    """An unused path under the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_root(spark)}/veilgraph/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    return materialize_at(df, new_path(df.sparkSession, tag))


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32 of the decimal text of col, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def with_bases(counts: DataFrame, key: list[str], part: str, n: str) -> DataFrame:
    """For each (key, part): how many of the key stand in earlier parts. counts holds one row for each key and part."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


#: A key is hot if it has over a thousandth of all rows, and this many; a hot key's rows are dealt to so many tasks.
HOT_LEAST, SALTS = 1000, 64


def attach(rows: DataFrame, right: DataFrame, keys: list[str], size: str, salt: str) -> DataFrame:
    """rows left-joined to right, whose keys are unique and whose column ``size`` counts a key's rows. A hot key's rows are
    salted by the column ``salt`` and the task, and its entry on the right repeated; at most a thousand keys can be hot, so their list is broadcast."""
    total = right.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > max(HOT_LEAST, total // 1000)
    hot = right.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
    own = rows.join(F.broadcast(hot), keys, "left")
    own = own.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit("salt"), F.col(salt), F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    each = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return own.join(right.withColumn("_salt", F.explode(each)).drop(size), [*keys, "_salt"], "left").drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, component), component being the least node reachable.

    ``edges`` has two long columns, ``a`` and ``b``; nodes without an edge don't appear. Alternates the
    large-star and small-star steps (Kiveris et al., 2014) until every node hangs on its least node. A step
    needs of each node only the least neighbour, so a hub's neighbours are pre-aggregated, never gathered.
    Each round is written to the shared folder, and the superseded one deleted.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    now = materialize_at(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        path,
    )
    mark = None
    while True:  # the steps end at a fixed point, after some log(n) rounds
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new_at = new_path(spark, "edges")
        new = materialize_at(small.where("u <> v").distinct(), new_at)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        delete(spark, path)
        now, path = new, new_at
        if got == mark:
            break
        mark = got
    root = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root)


LONG, INT, DOUBLE, STRING, BINARY = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType()


def schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_held: dict[object, object] = {}


def hold(key: object, build: Callable[[], object]):
    """This worker's one lasting memory (words, a model). Workers outlive stages, so what another operator
    left is given up first: a worker's memory is bounded by its largest operator, not by their sum."""
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Give up what an earlier operator left in this worker; operators that keep nothing begin with it."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
