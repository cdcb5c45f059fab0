"""op10: best-fit packing planned on a histogram of lengths.

Documents are encoded once; what is kept of each piece is its length and its rank among the pieces of that
length. Best-fit decreasing then runs over counts - at most ``capacity`` lengths, so the driver's share does not
grow with the documents - and gives, for a length and a range of ranks, sequences and offsets. Pieces take their
slots by rank within length: the rank in the task that encoded it plus the counts of earlier tasks.

Null and empty texts give a document of the end id alone. Repeated rows are packed each on its own; a null doc_id stays null. Texts of any length go through
whole and are cut only into pieces of the capacity. Ties between sequences of equal room go to those opened last. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe
from .common import INT, LONG, materialize, schema, table, with_bases

CAPACITY, END_ID = 4096, 1
PIECES = schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, part=INT, local=LONG)
PACKED = schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, sequence_id=LONG, offset=LONG)


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts. Rows: length, first rank, first sequence, pieces in each sequence, offset; and the number of sequences.

    Sequences with equal room left are kept as ranges, so a step places a whole range at once.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    rows, used = [], 0

    def leave(left: int, base: int, n: int) -> None:
        if left and n:
            if not room[left]:
                insort(rooms, left)
            room[left].append((base, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                base, n = room[left].pop()
                if not room[left]:
                    rooms.pop(at)
            else:
                left, base, n = capacity, used, -(-todo // (capacity // length))
                used += n
            each = left // length
            full = min(n, todo // each)
            if full:
                rows.append((length, rank, base, each, capacity - left))
                rank, todo = rank + full * each, todo - full * each
                leave(left - each * length, base, full)
            if todo and full < n:  # fewer than one sequence takes
                rows.append((length, rank, base + full, todo, capacity - left))
                leave(left - todo * length, base + full, 1)
                leave(left, base + full + 1, n - full - 1)
                todo = 0
            elif full < n:
                leave(left, base + full, n - full)
    return np.array(rows, dtype=np.int64).reshape(-1, 5), used


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = wordbpe.words(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = words.ids(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.append((doc, piece, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=PIECES.names)

    return run


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _take(plan, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        keys = rows[:, 0] * (1 << 45) + rows[:, 1]
        order = np.argsort(keys)
        rows, keys = rows[order], keys[order]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            own = rows[np.searchsorted(keys, length * (1 << 45) + rank, side="right") - 1]
            nth, place = np.divmod(rank - own[:, 1], own[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PACKED.names[:5]), pa.array(own[:, 2] + nth), pa.array(own[:, 4] + place * length)], names=PACKED.names)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece with its sequence and offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    staged = materialize(rows.mapInArrow(_pieces(tokenizer_path or wordbpe.default_path(), end_id, capacity), PIECES), "pieces")
    counts = staged.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in staged.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(plan_best_fit(histogram, capacity)[0])  # a few rows for each length
    bases = with_bases(counts, ["length"], "part", "n").select("length", "part", "base")
    ranked = staged.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    return ranked.select(*PACKED.names[:5], "rank").mapInArrow(_take(plan, capacity), PACKED)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
