"""Exact and approximate nearest-neighbour search by dot product.

Exact search of one query is a projection and a bounded top k (no exchange of the vectors). Many queries are
answered in blocks of at most about ``QUERY_BYTES``: a block is sent to the workers once, and every Arrow batch gives
the k best rows of each query (ties by key), so at most queries × k rows a batch are exchanged.
The approximate index is an inverted file: centroids fitted on a bounded sample, every vector assigned to the
nearest one, and a query reads only the partitions of its nearest centroids. How many these must be is measured on
that sample against brute force when the centroids are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.vector import dot, literal

QUERY_BYTES = 64 << 20  # of the query vectors that are sent to the workers at once
FIT_ROWS = 50_000
PROBE_TRIALS, PROBE_RECALL = 200, 0.95
PROBE_DEPTHS = (10, 100)  # numbers of results for which the lists to probe are measured


def top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding", digits: int | None = 9) -> DataFrame:
    """(key, score, distance, rank): descending dot product, ties by key. Scores are rounded before ranking."""
    score = dot(vector, literal(query))
    score = score if digits is None else F.round(score, digits)
    best = vectors.select(key, score.alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)
    return best.select(key, "score", (1.0 - F.col("score")).alias("distance"), F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the usable rows, their vectors)."""
    ok = np.array([v is not None and len(v) == width for v in column.to_pylist()], dtype=bool) if column.null_count else (np.diff(column.offsets.to_numpy()) == width)
    rows = np.flatnonzero(ok)
    taken = column.take(pa.array(rows))
    return rows, taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str = "query_id", vector: str = "embedding", digits: int = 9, index: InvertedFile | None = None, complexity: int = 64) -> DataFrame:
    """(query_key, key, score, rank) for each row of queries (query_key, embedding).

    With ``index``, vectors are its lists, and each query is compared only with those of its nearest centroids.
    """
    given = queries.where("embedding is not null")
    size = given.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 8).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    no = F.pmod(F.xxhash64(query_key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_answer(vectors, given.where(no == i), k, key, query_key, vector, digits, index, complexity) for i in range(blocks)])


def _answer(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str, digits: int, index: InvertedFile | None, complexity: int) -> DataFrame:
    """The answers to one block of queries, which is brought to the driver and sent to the workers."""
    asked = queries.select(query_key, F.col("embedding").cast("array<double>").alias("q")).collect()
    if not asked:
        return vectors.select(F.lit(None).cast("long").alias(query_key), key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    names = np.array([r[query_key] for r in asked])
    matrix = np.array([r["q"] for r in asked], dtype=np.float64)
    probed = index.probed(matrix, k, complexity) if index else None
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix, probed))
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *vectors.schema.fields]}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, q, probed_ = shared.value
        for batch in batches:
            rows, x = _matrix(batch.column(1), q.shape[1])
            if not len(rows):
                continue
            rank_of = np.empty(len(rows), dtype=np.int64)
            rank_of[np.asarray(pc.sort_indices(batch.column(0).take(pa.array(rows))))] = np.arange(len(rows))
            near = batch.column(2).to_numpy(zero_copy_only=False)[rows] if probed_ is not None else np.zeros(len(rows), dtype=np.int32)
            for c in np.unique(near):
                own = np.flatnonzero(near == c)
                asking = np.flatnonzero(probed_[:, c]) if probed_ is not None else np.arange(len(q))
                for lo in range(0, len(asking), 256):
                    some = asking[lo : lo + 256]
                    s = np.round(q[some] @ x[own].T, digits)
                    m = min(k, len(own))
                    edge = np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                    who, which = np.nonzero(-s <= edge)
                    if len(who) > m * len(some):  # of those that equal the k-th the smallest keys stay
                        place = rank_of[own[which]]
                        order = np.lexsort((place, -s[who, which], who))
                        first = np.searchsorted(who[order], np.arange(len(some)))
                        order = order[np.arange(len(order)) - first[who[order]] < m]
                        who, which = who[order], which[order]
                    yield pa.RecordBatch.from_arrays([pa.array(every[some[who]]), batch.column(0).take(pa.array(rows[own[which]])), pa.array(s[who, which])], names=[query_key, key, "score"])

    read = [key, vector]
    if index:
        vectors, read = vectors.where(F.col("centroid").isin([int(c) for c in np.flatnonzero(probed.any(0))])), [*read, "centroid"]
    found = vectors.select(*read).mapInArrow(best, f"{query_key} {types[query_key]}, {key} {types[key]}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


class InvertedFile:
    """An approximate index: centroids, and the vectors with the number of their centroid.

    ``needed`` has the lists that must be probed for ``PROBE_RECALL`` of the true neighbours, by the number of results;
    without it (an index saved by an earlier version) all are. ``complexity`` (64 by default, as in the build and
    search commands) asks for a share of the lists and can only add to them.
    """

    def __init__(self, centroids: np.ndarray, assigned: DataFrame, key: str, vector: str, needed: dict[int, int] | None = None):
        self.centroids, self.assigned, self.key, self.vector, self.needed = centroids, assigned, key, vector, needed or {}

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str = "embedding", lists: int | None = None, seed: int = 7) -> InvertedFile:
        """Fits the centroids on at most FIT_ROWS rows (by a hash of the key); assigns every vector.

        By default there are as many lists as the root of the number of vectors, but a centroid needs 20 rows of the
        sample.
        """
        usable = vectors.where(F.col(vector).isNotNull())
        rows = usable.count()
        lists = lists or max(1, min(round(rows**0.5), min(rows, FIT_ROWS) // 20))
        share = min(1.0, 0.9 * FIT_ROWS / max(1, rows))
        picked = usable.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).select(vector).limit(FIT_ROWS).toArrow()
        column = picked.column(0).combine_chunks()
        width = len(column[0]) if len(column) else 1
        x = _matrix(column, width)[1]
        centroids = _k_means(x, lists, seed)
        return cls(centroids, cls._assign(usable, centroids, key, vector), key, vector, {k: _lists_needed(centroids, x, k, seed) for k in PROBE_DEPTHS})

    @classmethod
    def build_with(cls, centroids: np.ndarray, vectors: DataFrame, key: str, vector: str = "embedding") -> InvertedFile:
        """Assigns vectors to given centroids."""
        return cls(centroids, cls._assign(vectors.where(F.col(vector).isNotNull()), centroids, key, vector), key, vector)

    @staticmethod
    def _assign(vectors: DataFrame, centroids: np.ndarray, key: str, vector: str) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)
        kind = dict(vectors.dtypes)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                rows, x = _matrix(batch.column(1), c.shape[1])
                near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1).astype(np.int32)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near)], names=[key, vector, "centroid"])

        return vectors.select(key, vector).mapInArrow(assign, f"{key} {kind[key]}, {vector} {kind[vector]}, centroid int")

    def add(self, more: DataFrame) -> InvertedFile:
        """Appends vectors to the lists of the existing centroids."""
        return InvertedFile(self.centroids, self.assigned.unionByName(self._assign(more, self.centroids, self.key, self.vector)), self.key, self.vector, self.needed)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Writes the lists, one partition per centroid, and the centroids beside them. ``append`` keeps the latter."""
        self.assigned.write.mode(mode).partitionBy("centroid").parquet(f"{path}/lists")
        if mode != "append":
            rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
            self.assigned.sparkSession.createDataFrame(rows, "centroid int, center array<double>").coalesce(1).write.mode(mode).parquet(f"{path}/centroids")
            self.assigned.sparkSession.createDataFrame(list(self.needed.items()), "results int, lists int").coalesce(1).write.mode(mode).parquet(f"{path}/needed")

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str, vector: str = "embedding") -> InvertedFile:
        centers = spark.read.parquet(f"{path}/centroids").orderBy("centroid").collect()  # as many rows as lists
        try:
            needed = {r["results"]: r["lists"] for r in spark.read.parquet(f"{path}/needed").collect()}
        except AnalysisException:
            needed = {}
        return cls(np.array([r["center"] for r in centers]), spark.read.parquet(f"{path}/lists"), key, vector, needed)

    def probed(self, queries: np.ndarray, k: int, complexity: int = 64) -> np.ndarray:
        """queries × lists: whether the query probes the list. Results beyond the measured depths need all lists."""
        lists = len(self.centroids)
        least = next((self.needed[d] for d in sorted(self.needed) if k <= d), lists)
        count = max(1, min(lists, max(least, round(lists * complexity / 256))))
        order = np.argsort(-_nearness(queries, self.centroids), axis=1, kind="stable")[:, :count]
        out = np.zeros((len(queries), lists), dtype=bool)
        np.put_along_axis(out, order, True, axis=1)
        return out

    def search(self, query: Sequence[float], k: int, complexity: int = 64) -> DataFrame:
        """(key, score, distance, rank): the vectors of the probed lists, ranked exactly."""
        lists = np.flatnonzero(self.probed(np.asarray([query], dtype=np.float64), k, complexity)[0])
        return top_k(self.assigned.where(F.col("centroid").isin([int(c) for c in lists])), query, k, self.key, self.vector)

    def search_many(self, queries: DataFrame, k: int, complexity: int = 64, query_key: str = "query_id") -> DataFrame:
        """(query_key, key, score, rank) for each row of queries (query_key, embedding)."""
        return top_k_many(self.assigned, queries, k, self.key, query_key, self.vector, index=self, complexity=complexity)


def _nearness(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rows × centroids: the higher, the nearer."""
    return x @ centroids.T - 0.5 * (centroids * centroids).sum(1)


def _lists_needed(centroids: np.ndarray, x: np.ndarray, k: int, seed: int) -> int:
    """How many of its nearest lists some rows must probe for PROBE_RECALL of their k best other rows."""
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centroids)
    some = np.random.default_rng(seed).choice(len(x), min(PROBE_TRIALS, len(x)), replace=False)
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -np.inf
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    near = _nearness(x, centroids).argmax(1)
    place = np.argsort(np.argsort(-_nearness(x[some], centroids), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, near[best], axis=1), PROBE_RECALL, method="higher")) + 1


def _k_means(x: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centroids.T - 0.5 * (centroids * centroids).sum(1)).argmax(1)
        for j in range(lists):
            own = x[near == j]
            centroids[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return centroids
