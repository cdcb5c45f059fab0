"""op8: approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of residuals are fitted on a bounded sample; every vector is indexed. A query is
compared with the codes of its nearest lists through asymmetric distance tables, the best of all are ranked again by exact
distances in double precision. How many lists a query visits is first fitted on the sample for each nearest list of its own, so that a dense group can't be
outweighed by the rest. Then recall is measured: trial vectors from outside the sample search the whole index and are held
against brute force over all rows, and lists visited and codes kept are doubled until the wanted share of true neighbours
is found; at the end of the doubling everything is visited and kept, which is exact. Besides, every query visits lists until they hold
enough vectors for a full answer. ``exact`` answers by brute force alone, in blocks of queries.

Equal vectors are one class in the index and expand at the end to as many of their rows, least ids first, as an answer can need, so copies
cost nothing and ties go to smaller ids. Lists are stored in blocks and a task holds one block and one block of queries.

Vectors of another length are no neighbours: each length has its own index (a driver loop over the distinct lengths).
Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Rows are the unit: each row of a repeated
id is a candidate and, if asked, a query (its ranks then stand once for each such row); a query's own row alone is no candidate. With
fewer than k candidates all are returned. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOUBLE, LONG, materialize, schema, table
from .vectors import by_hash, element_kind, kmeans, lengths, matrix, nearest, sample, usable

K, QUERY_EVERY = 10, 100
#: Fitting: sampled vectors, queries of a list, share of true neighbours in the visited lists, most lists, dimensions of a code's byte.
SAMPLE, TRIALS, RECALL, LISTS, DIMENSIONS = 16_384, 8, 0.97, 4096, 2
#: Measuring: trial queries from outside the sample, and the share of their true neighbours that a search must find.
MEASURED, TARGET = 256, 0.95
#: Codes kept of a query for exact ranking, to begin with; most and least vectors in a block of codes; queries in a block; queries of a brute-force block.
KEEP, BLOCK, BLOCK_LEAST, QUERIES, EXACT_QUERIES = 100, 8192, 256, 256, 4096


class Index:
    def __init__(self, learn: np.ndarray, n: int, k: int):
        self.centers = kmeans(learn, min(LISTS, max(1, round(2 * math.sqrt(n)))))
        own = nearest(learn, self.centers)
        residual = learn - self.centers[own]
        d = learn.shape[1]
        self.cuts = [slice(a, min(a + DIMENSIONS, d)) for a in range(0, d, DIMENSIONS)]
        few = residual[:8192]
        self.books = [kmeans(few[:, c], 256, steps=5) for c in self.cuts]
        # rank of the list that holds each true neighbour, over trial queries of each list
        by_list = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[by_list], np.arange(len(self.centers)))
        trials = by_list[np.arange(len(own)) - starts[own[by_list]] < TRIALS]
        k, squares = min(k, len(learn) - 1), (learn * learn).sum(1)
        self.visits = np.zeros(len(self.centers), np.int64)
        ranks = np.zeros((len(trials), k), np.int64)
        for a in range(0, len(trials) if k else 0, 256):
            t = trials[a : a + 256]
            far = squares - 2 * learn[t] @ learn.T
            far[np.arange(len(t)), t] = np.inf
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            centers = self.to_centers(learn[t])
            ranks[a : a + 256] = [(c[None, :] < c[own[n], None]).sum(1) for c, n in zip(centers, near)]
        for one in np.unique(own):
            mine = np.sort(ranks[own[trials] == one].ravel())
            self.visits[one] = 1 + (mine[min(len(mine) - 1, math.ceil(RECALL * len(mine)))] if len(mine) else 0)
        self.visits[self.visits == 0] = self.visits.max()

    def store(self, sizes: dict[int, int], block: int) -> None:
        """Takes the number of vectors in each list. Lists that lie close share a group of about ``block`` vectors, the unit of storage."""
        self.sizes = np.array([sizes.get(k, 0) for k in range(len(self.centers))], np.int64)
        main = np.linalg.svd(self.centers - self.centers.mean(0), full_matrices=False)[2][0]
        order = np.argsort(self.centers @ main, kind="stable")
        held = self.sizes[order]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = (np.cumsum(held) - held) // block

    def lists_for(self, x: np.ndarray, widen: float, least: int) -> list[np.ndarray]:
        """The lists that each query visits: those fitted, times ``widen``, and on until they hold ``least`` vectors."""
        out = []
        for row in np.argsort(self.to_centers(x), axis=1, kind="stable"):
            enough = int(np.searchsorted(np.cumsum(self.sizes[row]), least)) + 1
            out.append(row[: max(math.ceil(self.visits[row[0]] * widen), enough)])
        return out

    def to_centers(self, x: np.ndarray) -> np.ndarray:
        return (self.centers * self.centers).sum(1) - 2 * x @ self.centers.T

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centers)
        residual = x - self.centers[own]
        return own, np.stack([nearest(residual[:, c], b).astype(np.uint8) for c, b in zip(self.cuts, self.books)], axis=1)

    def offsets(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For a code in its list: |residual|^2 + 2 centroid . residual, the part of a squared distance that no query changes."""
        residual = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return (residual * (residual + 2 * self.centers[own])).sum(1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: -2 x . codeword for each query, part and codeword."""
        out = np.zeros((len(x), len(self.books), 256))
        for k, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[:, k, : len(b)] = -2 * x[:, c] @ b.T
        return out


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if len(batch):
                own, codes = index.encode(matrix(batch.column("embedding")))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own), packed], names=["node", "list", "code"])

    return run


def _route(shared, widen: float, least: int):
    """A row for each query and group of lists that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if len(batch):
                at, group, own = [], [], []
                for k, row in enumerate(index.lists_for(matrix(batch.column("embedding")), widen, least)):
                    row = row[index.sizes[row] > 0]
                    g = index.group[row]
                    for one in np.unique(g):
                        at.append(k)
                        group.append(one)
                        own.append(np.sort(row[g == one]).tolist())
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(at, pa.int64())), batch.column("embedding").take(pa.array(at, pa.int64())), pa.array(group, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["query", "embedding", "group", "lists"])

    return run


def _scan(shared, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        shift = 256 * np.arange(len(index.cuts))
        for batch in batches:
            for row in range(len(batch)):
                codes, queries = (batch.column(c)[row].values for c in ("codes", "queries"))
                nodes, own = codes.field("node").to_numpy(), codes.field("list").to_numpy()
                code = np.frombuffer(b"".join(codes.field("code").to_pylist()), np.uint8).reshape(len(nodes), -1)
                fixed, at = index.offsets(own, code), code + shift
                x = matrix(queries.field("embedding"))
                tables = index.tables(x).reshape(len(x), -1)
                lead = index.to_centers(x)  # |x - centroid|^2 without |x|^2, which changes no order
                for k, (q, visits) in enumerate(zip(queries.field("query").to_pylist(), queries.field("lists").to_pylist())):
                    mine = np.flatnonzero(np.isin(own, visits))
                    got, guess = nodes[mine], lead[k, own[mine]] + fixed[mine] + tables[k][at[mine]].sum(1)
                    if len(got) > keep:
                        best = np.lexsort((got, guess))[:keep]
                        got, guess = got[best], guess[best]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), q, np.int64)), pa.array(got), pa.array(guess)], names=["query", "node", "guess"])

    return run


def _brute(shared, keep: int):
    """Of a task's vectors the ``keep`` nearest to each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        nodes, far = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                y = matrix(part.column("embedding"))
                far = np.concatenate([far, (y * y).sum(1) - 2 * x @ y.T], axis=1)
                nodes = np.concatenate([nodes, np.broadcast_to(part.column("node").to_numpy(), (len(x), len(y)))], axis=1)
                if far.shape[1] > keep:
                    best = np.argpartition(far, keep - 1, axis=1)[:, :keep]
                    far, nodes = np.take_along_axis(far, best, 1), np.take_along_axis(nodes, best, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, far.shape[1])), pa.array(nodes.ravel()), pa.array(far.ravel())], names=["query", "node", "guess"])

    return run


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


GUESS = schema(query=LONG, node=LONG, guess=DOUBLE)


def _best(guesses: DataFrame, keep: int) -> DataFrame:
    return guesses.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("guess", "node"))).where(f"k <= {keep}").select("query", "node")


class Searcher:
    """The index over all rows of one length. ``recall`` is the measured one, of ``widen`` times the fitted visits and ``keep`` codes."""

    def __init__(self, rows: DataFrame, k: int, target: float = TARGET):
        """rows: vec_id, embedding, row (unique)."""
        self.k, self.spark = k, rows.sparkSession
        self.width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        w = Window.partitionBy("embedding").orderBy("vec_id", "row")
        first = F.first("row").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        members = rows.select("embedding", "vec_id", "row", F.row_number().over(w).alias("k"), first.alias("node")).where(f"k <= {k + 1}")
        self.members = materialize(members.withColumn("embedding", F.when(F.col("k") == 1, F.col("embedding"))), "members")
        self.classes = self.members.where("k = 1").select("node", F.col("vec_id").alias("least"), "embedding")
        self.n = self.classes.count()
        self.widen, self.keep, self.recall = 1, max(KEEP, k + 1), 1.0
        index = Index(sample(self.classes, SAMPLE), self.n, k)
        self.codes = materialize(self.classes.mapInArrow(_index(self.spark.sparkContext.broadcast(index)), "node long, list long, code binary"), "codes")
        self.block = min(BLOCK, max(BLOCK_LEAST, self.n // (2 * self.width)))
        index.store({r["list"]: r["count"] for r in self.codes.groupBy("list").count().collect()}, self.block)  # at most LISTS rows
        self.lists, self.shared = len(index.centers), self.spark.sparkContext.broadcast(index)
        held = np.bincount(index.group, index.sizes).astype(np.int64)
        rows_ = [(k, int(g), int(-(-held[g] // self.block))) for k, g in enumerate(index.group)]
        self.stored = F.broadcast(self.spark.createDataFrame(rows_, "list long, group long, blocks int"))  # at most LISTS rows
        self._measure(target)

    def _measure(self, target: float) -> None:
        trials = materialize(self.classes.orderBy(*[c.desc() for c in by_hash()]).limit(MEASURED).select(F.col("node").alias("query"), "embedding"), "trials")
        far = lambda best: self.ranked(best, trials).groupBy("query").agg(F.sort_array(F.collect_list("score")).alias("s"))  # noqa: E731  at most k + 1 each
        truth = {r.query: r.s[1:] for r in far(self.brute(trials)).collect()}
        wanted = sum(map(len, truth.values()))
        while wanted:
            got = {r.query: r.s[1:] for r in far(self.near(trials)).collect()}
            found = sum(sum(x <= s[-1] * (1 + 1e-9) for x in got.get(q, [])) for q, s in truth.items() if s)
            self.recall = min(1.0, found / wanted)
            if self.recall >= target or self.widen >= self.lists and self.keep >= self.n:
                break
            self.widen, self.keep = self.widen * 2, self.keep * 2

    def near(self, asked: DataFrame) -> DataFrame:
        """Candidates (query, node) of asked (query, embedding) by the index."""
        block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
        placed = self.codes.join(self.stored, "list").withColumn("block", block).repartition("group", "block")
        blocks = placed.groupBy("group", "block").agg(F.collect_list(F.struct("node", "list", "code")).alias("codes"))
        routed = asked.mapInArrow(_route(self.shared, self.widen, self.k + 1), f"query long, embedding {element_kind(asked)}, group long, lists array<long>")
        routed = materialize(routed, "routed")
        counts = routed.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("query", F.lit(4)), F.col("parts")).cast("int")
        # a row for each group, at most LISTS
        grouped = routed.join(F.broadcast(counts), "group").withColumn("part", part).repartition("group", "part")
        grouped = grouped.groupBy("group", "part").agg(F.collect_list(F.struct("query", "embedding", "lists")).alias("queries"))
        # dealt by work, not by bytes: the rows are small and costly
        pairs = blocks.join(grouped, "group").repartition(self.width, "group", "block", "part").select("codes", "queries")
        return _best(pairs.mapInArrow(_scan(self.shared, self.keep), GUESS), self.keep)

    def brute(self, asked: DataFrame) -> DataFrame:
        """Candidates of asked by comparing every vector; asked goes to each task, so it must be a bounded block."""
        got = asked.select("query", "embedding").toArrow()
        block = (got.column("query").to_numpy().astype(np.int64), matrix(got.column("embedding")))
        if not len(got):
            return self.spark.createDataFrame([], "query long, node long")
        keep = 2 * (self.k + 1)  # twice what is ranked exactly, for rounding
        return _best(self.classes.mapInArrow(_brute(self.spark.sparkContext.broadcast(block), keep), GUESS), keep)

    def ranked(self, best: DataFrame, asked: DataFrame) -> DataFrame:
        """The k + 1 nearest classes of each query by exact distance."""
        exact = best.join(asked.select("query", "embedding"), "query").join(self.classes.select("node", "least", F.col("embedding").alias("other")), "node")
        exact = exact.select("query", "node", "least", euclid(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")).alias("score"))
        order = Window.partitionBy("query").orderBy("score", "least", "node")
        return exact.withColumn("k", F.row_number().over(order)).where(f"k <= {self.k + 1}").drop("k", "least")

    def answers(self, candidates: Callable[[DataFrame], DataFrame], asked: DataFrame) -> DataFrame:
        """asked: query (the row's number), query_id, embedding."""
        rows = self.ranked(candidates(asked), asked).join(self.members.select("node", "vec_id", "row"), "node").where("row <> query")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row"))
        rows = rows.withColumn("rank", rank.cast("int")).where(f"rank <= {self.k}")
        return rows.join(asked.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")


ANSWER = "query_id long, rank int, vec_id long, score double"


def _rows(vectors: DataFrame, asked: Column) -> DataFrame:
    kind = element_kind(vectors)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.coalesce(asked, F.lit(False)).alias("asked"))
    return materialize(usable(rows).withColumn("row", F.monotonically_increasing_id()), "vectors")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("asked").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "embedding")


def search(vectors: DataFrame, asked: Column, k: int = K, target: float = TARGET) -> DataFrame:
    """vectors: (vec_id, embedding); asked: a condition on its columns that holds for queries. Returns query_id, rank, vec_id, score."""
    rows = _rows(vectors, asked)
    out = vectors.sparkSession.createDataFrame([], ANSWER)
    for dim in lengths(rows):
        own = rows.where(F.col("dim") == dim)
        searcher = Searcher(own, k, target)
        out = out.union(searcher.answers(searcher.near, _asked(own)))
    return out


def exact(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """As search, by brute force: a pass over all vectors for each EXACT_QUERIES queries."""
    rows = _rows(vectors, asked)
    out = vectors.sparkSession.createDataFrame([], ANSWER)
    for dim in lengths(rows):
        own = rows.where(F.col("dim") == dim)
        searcher, queries = Searcher(own, k, 0.0), _asked(own)
        blocks = -(-queries.count() // (EXACT_QUERIES // 2))
        for b in range(blocks):  # a hash deals them, so a block holds about half of EXACT_QUERIES
            part = queries.where(F.pmod(F.xxhash64("query", F.lit(5)), F.lit(blocks)) == b)
            out = out.union(searcher.answers(searcher.brute, part))
    return out


def op8_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
