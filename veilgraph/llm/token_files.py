"""op1: token ids in Parquet list columns, in ascending doc_id order, and selective reads of them.

A row holds one document: ``doc_id``, ``part`` (its file's number), ``file_start`` (ids of the documents before it in
that file), ``n_tokens`` and ``tokens`` (int list). Token ids are dictionary-encoded (16-bit indexes at this
vocabulary's size); ids, starts and counts are delta-encoded. Row groups and pages are small and pages carry
min/max indexes, so a reader of one doc_id range or of metadata alone touches only those pages.

Nulls and empty texts give a document of the end id alone. Null doc_ids come first. Documents of equal doc_id stand in the order of their
texts' hashes and, however many, are dealt to as many files as they fill: files are cut by doc_id, text hash and row, not by doc_id alone. Repeated
rows stay documents. Texts of any length go through whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordbpe
from .common import INT, LONG, new_path, schema, table, with_bases

END_ID = 2
FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
FILE_SCHEMA = schema(doc_id=LONG, part=INT, file_start=LONG, n_tokens=LONG, tokens=T.ArrayType(INT))


def _encode(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = wordbpe.words(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(ids), 500):  # a few MB of ids at a time
                packed = [words.ids(t.as_py()) + end for t in texts.slice(at, 500)]
                n = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                ends = np.cumsum(n)
                flat = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 500), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), lists],
                    names=FILE_SCHEMA.names,
                )
                start += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str | None = None, end_id: int = END_ID, files: int | None = None) -> str:
    """Encode docs(doc_id, text) and write the token files under ``out``, sorted by doc_id within and across files."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "hash", "row"]
    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("hash", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer_path or wordbpe.default_path(), end_id), FILE_SCHEMA)
        .write.options(**FILE_OPTIONS)
        .parquet(out)
    )
    return out


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens; the token column isn't read."""
    return _placed(spark, spark.read.schema(FILE_SCHEMA).parquet(path).drop("tokens"), path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and tokens. A filter on doc_id reaches the row groups and pages."""
    return _placed(spark, spark.read.schema(FILE_SCHEMA).parquet(path), path)


def _placed(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    per_file = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = with_bases(per_file.withColumn("one", F.lit(1)), ["one"], "part", "n").select("part", "base")
    # one row for each file that was written: bounded by the file count, not by the documents
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("file_start")).drop("base", "file_start", "part")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        flat, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].data) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    back = read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens")
    return back.mapInArrow(_crcs, schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG))
