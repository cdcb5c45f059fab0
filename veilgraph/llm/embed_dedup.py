"""op6: near-duplicate vectors by an inverted multi-index.

Independent codebooks for the two halves of unit vectors form a grid of cells. From the vectors of a cell the multi-sequence
algorithm (Babenko and Lempitsky, 2012) visits cells by rising sum of
squared gaps of the halves, until that sum exceeds the squared distance 2 - 2 * threshold. A half's gap to another center is the least
distance of a vector of the cell from the plane half-way to that center. A link crosses that plane if its other end lies
beyond it, so no sum of squared gaps exceeds the link's squared distance: nothing is fitted, the target recall is 1 and no link is lost, however the
links lie. Visited cells are verified in double precision.

Cells that follow one another in the grid are stored in tiles of up to ``tile`` vectors, the unit that is shipped: a pair of tiles meets once if a cell of one
visits a cell of the other, and only visited cells are compared. A part of the grid that holds more is dealt into tiles by hash. Of a pair of tiles
only each vector's number of links and its component leave the task, never the pairs. Equal vectors of a label are one class, so copies cost nothing.

Vectors link within a label and a length; each length has its own index (a driver loop over the distinct lengths). Vectors that are null, zero or hold
null or non-finite components, or have no label: no links, component themselves. Rows are the unit: rows of a repeated vec_id each have their own vector's
links and component, a row without vec_id links like any other and only names no component (its own is null where no linked row has an id).
``kept`` is vec_id = component_id, false without an id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, attach, connected_components, materialize, schema, table
from .vectors import element_kind, kmeans, lengths, matrix, sample, takes_part, unit, usable

THRESHOLD = 0.93
#: Vectors for the codebooks (also the most centers of a half); vectors wanted in a cell; a tile's most vectors and bytes, and the tiles wanted at least.
SAMPLE, CELL, TILE, TILE_BYTES, TILES = 16_384, 128, 4096, 4 << 20, 32
#: Centers closer than this count as one; what rounding may add to a sum of squared gaps.
SAME, ROUNDING = 1e-6, 1e-6


def distances(u: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = u.shape[1] // 2
    return tuple((x * x).sum(1)[:, None] - 2 * x @ b.T + (b * b).sum(1) for x, b in zip((u[:, :half], u[:, half:]), books))


def multi_sequence(g1: np.ndarray, g2: np.ndarray, most: float) -> list[int]:
    """Cells i * len(g2) + j by rising g1[i] + g2[j], up to most."""
    o1, o2 = np.argsort(g1, kind="stable"), np.argsort(g2, kind="stable")
    s1, s2 = g1[o1], g2[o2]
    out, heap, seen = [], [(s1[0] + s2[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * len(g2) + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def gaps(d: np.ndarray, book: np.ndarray, own: int) -> np.ndarray:
    """Squared: how near vectors at squared distances d to the centers, all nearest to center own, come to the half-space of each other center."""
    apart = np.sqrt(((book - book[own]) ** 2).sum(1))
    gap = np.maximum(d - d[:, own : own + 1], 0).min(0) / (2 * np.maximum(apart, SAME))
    return np.where(apart > SAME, gap * gap, 0.0)


def _cells(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if len(batch):
                d1, d2 = distances(unit(matrix(batch.column("embedding"))), books)
                cell = d1.argmin(1) * len(books[1]) + d2.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    return run


def _runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values."""
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    return list(zip(np.r_[0, cuts], np.r_[cuts, len(sorted_)])) if len(sorted_) else []


def _visits(shared, threshold: float):
    """A row for each tile and part of the grid, from the tile's own on, that its cells visit: from which cell to which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        cells = len(books[0]) * len(books[1])
        for batch in batches:
            for row in range(len(batch)):
                held, parts, part = batch.column("rows")[row].values, batch.column("parts")[row].as_py(), batch.column("part")[row].as_py()
                cell = held.field("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                u = unit(matrix(held.field("embedding")))
                there: dict[int, tuple[list[int], list[int]]] = {}
                for a, b in _runs(cell[order]):
                    own = int(cell[order[a]])
                    i, j = divmod(own, len(books[1]))
                    d1, d2 = distances(u[order[a:b]], books)
                    for to in multi_sequence(gaps(d1, books[0], i), gaps(d2, books[1], j), 2 - 2 * threshold + ROUNDING):
                        if (there_part := to * parts // cells) >= part:
                            pair = there.setdefault(there_part, ([], []))
                            pair[0].append(own)
                            pair[1].append(to)
                at = pa.array(np.full(len(there), row), pa.int64())
                lists = [pa.array([v[k] for v in there.values()], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("label", "part", "sub")], pa.array(there.keys(), pa.int64()), *lists], names=["label", "part", "sub", "to_part", "cells", "to"])

    return run


def _near(a, b, visits: dict[int, np.ndarray], threshold: float) -> np.ndarray:
    """Which of a's vectors link with which of b's; both (cell, unit vectors), sorted by cell."""
    near = np.zeros((len(a[0]), len(b[0])), bool)
    for lo, hi in _runs(a[0]):
        to = visits.get(int(a[0][lo]))
        if to is None:
            continue
        cols = np.flatnonzero(np.isin(b[0], to))
        full = len(cols) == len(b[0])
        other = b[1].T if full else b[1][cols].T
        for at in range(lo, hi, 512):
            found = a[1][at : min(hi, at + 512)] @ other >= threshold
            if full:
                near[at : at + len(found)] = found
            else:
                near[at : at + len(found), cols] = found
    return near


def _islands(near: np.ndarray, same: bool) -> np.ndarray:
    """The least index of each row's component; rows and, if not ``same``, then columns are the nodes."""
    shift = 0 if same else len(near)
    n = shift + near.shape[1]
    own = np.arange(n, dtype=np.int32)
    while True:
        new = own.copy()
        for at in range(0, len(near), 512):
            part = near[at : at + 512]
            rows = slice(at, at + len(part))
            new[rows] = np.minimum(new[rows], np.where(part, own[None, shift:], n).min(axis=1, initial=n))
            new[shift:] = np.minimum(new[shift:], np.where(part, own[rows, None], n).min(axis=0, initial=n))
        new = new[new]
        if (new == own).all():
            return own
        own = new


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                same, sides = batch.column("same")[row].as_py(), []
                for c in ("rows_a",) if same else ("rows_a", "rows_b"):
                    held = batch.column(c)[row].values
                    order = np.argsort(held.field("cell").to_numpy(), kind="stable")
                    node, m, cell = (held.field(f).to_numpy()[order] for f in ("node", "m", "cell"))
                    sides.append((cell, unit(matrix(held.field("embedding"))[order]), node, m))
                a, b = sides[0], sides[-1]
                froms, to = (batch.column(c)[row].values.to_numpy() for c in ("cells", "to"))
                order = np.argsort(froms, kind="stable")
                near = _near(a, b, {int(froms[order[x]]): to[order[x:y]] for x, y in _runs(froms[order])}, threshold)
                if same:
                    near |= near.T  # a link is found from one of its ends at least
                    np.fill_diagonal(near, False)
                in_a, in_b = near.any(axis=1), near.any(axis=0)
                if not in_a.any():
                    continue
                near = near[np.ix_(in_a, in_b)]
                nodes, links = a[2][in_a], near @ b[3][in_b]
                if not same:
                    nodes, links = np.r_[nodes, b[2][in_b]], np.r_[links, near.T @ a[3][in_a]]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(nodes[_islands(near, same)])], names=["node", "links", "root"])

    return run


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """classes of one length: label, embedding, node, m. Rows node, links, root: links found in a pair of tiles and the node's component there."""
    spark = classes.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind, group = element_kind(classes), f"label {classes.schema['label'].dataType.simpleString()}"
    by_label = classes.groupBy("label").agg(F.count("*").alias("n"))
    size = by_label.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    learn = unit(sample(classes, SAMPLE))
    half = learn.shape[1] // 2
    side = max(2, math.ceil(math.sqrt(size.most / CELL)))
    books = (kmeans(learn[:, :half], side), kmeans(learn[:, half:], side))
    cells = len(books[0]) * len(books[1])
    tile = max(1, min(TILE, TILE_BYTES // (8 * learn.shape[1]), max(512, size.n // TILES)))
    shared = spark.sparkContext.broadcast(books)
    placed = classes.select("label", "embedding", "node", "m").mapInArrow(_cells(shared), f"{group}, embedding {kind}, node long, m long, cell long")

    # where a cell is stored: a part of its label's grid, of which there is one for each tile's worth of vectors, in as many tiles as the part fills
    held = materialize(placed.groupBy("label", "cell").agg(F.count("*").alias("n")), "cells")
    parts = held.groupBy("label").agg(F.ceil(F.sum("n") / tile).cast("long").alias("parts"), F.count("*").alias("cells"))
    held = attach(held, parts, ["label"], "cells", "cell").withColumn("part", F.expr(f"cell * parts div {cells}"))
    subs = materialize(held.groupBy("label", "part").agg(F.ceil(F.sum("n") / tile).cast("int").alias("subs"), F.count("*").alias("cells")), "parts")
    held = materialize(attach(held, subs, ["label", "part"], "cells", "cell"), "cells")
    placed = attach(placed, held, ["label", "cell"], "n", "node").withColumn("sub", F.pmod(F.xxhash64("node", F.lit(2)), F.col("subs")).cast("int"))
    tiles = placed.repartition("label", "part", "sub").groupBy("label", "part", "sub", "parts").agg(F.collect_list(F.struct("cell", "node", "m", "embedding")).alias("rows"))
    tiles = materialize(tiles, "tiles")

    visits = materialize(tiles.mapInArrow(_visits(shared, threshold), f"{group}, part long, sub int, to_part long, cells array<long>, to array<long>"), "visits")
    to = subs.select("label", F.col("part").alias("to_part"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("to_sub"))
    pairs = visits.join(to, ["label", "to_part"]).where("to_part > part or to_sub >= sub")
    a = tiles.select("label", "part", "sub", F.col("rows").alias("rows_a"))
    b = tiles.select("label", F.col("part").alias("to_part"), F.col("sub").alias("to_sub"), F.col("rows").alias("rows_b"))
    # a tile's vectors are shipped to each tile that they meet; dealt by work, not by bytes
    to_key = ["label", "to_part", "to_sub"]
    met = pairs.join(a, ["label", "part", "sub"]).repartition(width, *to_key).join(b.repartition(width, *to_key), to_key)
    met = met.select(((F.col("to_part") == F.col("part")) & (F.col("to_sub") == F.col("sub"))).alias("same"), "cells", "to", "rows_a", "rows_b")
    return materialize(met.mapInArrow(_compare(threshold), schema(node=LONG, links=LONG, root=LONG)), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors: (vec_id, embedding, label). Returns vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(element_kind(vectors)), F.col("label"))
    own = usable(rows).where("label is not null")
    classes = own.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = spark.createDataFrame([], schema(node=LONG, links=LONG, root=LONG))
    for dim in lengths(classes):
        found = found.union(_links(classes.where(F.col("dim") == dim), threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))

    # a row finds its class by two hashes of its vector, which are shipped instead of it; by the vector itself should they ever clash
    marks = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    known = classes.select("label", "dim", "node", "least", "m", "embedding", *marks).join(links, "node", "left").join(parts, "node", "left")
    known = materialize(known.drop("embedding").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("m") - 1).withColumn("component", F.coalesce("component", "node")), "known")
    key = ["label", "dim", "h1", "h2"]
    if not known.groupBy(*key).count().where("count > 1").isEmpty():
        known, key = known.join(classes.select("node", "embedding"), "node"), ["label", "dim", "embedding"]
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    known = attach(known, least, ["component"], "nodes", "node").select(*key, "links", "component_id", "m")
    marked = own.select("vec_id", "label", "dim", "embedding", *marks).select("vec_id", *key)
    alone = rows.where(~(takes_part() & F.col("label").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    placed = alone.union(attach(marked, known, key, "m", "vec_id").select("vec_id", "links", "component_id"))
    return placed.select("vec_id", F.col("links").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
