"""Problem 2: the k most similar vectors of the same index for every vector, by a forest of random projections.

Every tree splits its rows in halves by random hyperplanes (the difference of two centres that start at two random
rows and move for a few rounds on a small sample; the threshold is the median). A query's priority at a leaf is the
smallest signed margin on the path to it. One queue shared by all trees visits the leaves of all trees in the order
of these priorities; since a child never has a higher priority than its parent, that best-first order is the
descending order of the leaves' own priorities, so for a block of queries it is found at once as a selection over all
leaves. How many leaves are visited is measured in every shard: for ``TRIALS`` of its queries the true neighbours are
computed, and the queue goes as far as ``VISIT_RECALL`` of them need. The rows of the visited leaves are the candidates;
the best of every leaf are then reranked exactly, in double precision.

Scale. An index of up to ``SHARD_ROWS`` rows is one task's work: each row is shuffled once. A larger index is routed
by a coarse tree of the same kind, which a task of its own fits on a sample of about ``SAMPLE_ROWS`` rows of the index
(the only use of a sample; every row is indexed): a row is stored in its shard and asks there and in the next shards of
its queue. How many is measured on the sample, so that ``ROUTE_RECALL`` of the true neighbours in it lie in the shards
asked; the more random the vectors, the more shards that takes, and the more often they are sent. A shard with more
than twice the limit of stored rows or of queries becomes a grid of tasks: its rows are dealt out to sub-shards and
its queries to blocks by a hash, and every block asks every sub-shard, so no task is large and no bound drops a row.
The coarse trees are all that the driver and the workers hold: one hyperplane for every SHARD_ROWS rows.
Copies: of vectors with the same direction (to six decimals of the unit vector) more than k + 1 times, the k + 1
smallest ids take part in the search and the others get the k smallest ids directly, which is the exact answer with
ties going to the smaller id.

Defined cases: a vector takes part if it is not null, as wide as the index's dimensions, finite in all elements and
not all zero; vectors of indexes without metadata take no part; of a repeated vec_id the latest arrival counts; ties
go to the smaller id; an index with fewer than k + 1 vectors gives what there is; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, join_crowded, latest

TREES, LEAF_ROWS, EXTRA = 16, 128, 3
FIRST, GROW = 8, 4  # leaves of the first round of visits, and how much further each round goes
TRIALS, VISIT_RECALL = 200, 0.97
SHARD_ROWS, SAMPLE_ROWS, ROUTE_RECALL, SPREAD = 65_536, 20_000, 0.97, 0.25
BLOCK, QUERIES = 1_024, 8_192


class Tree:
    """A complete binary tree of hyperplanes in heap order; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator, spread: float = 0.0):
        """``spread``: how far a half may differ from one half of the rows, to cut between the centres instead."""
        self.depth = depth
        inner = (1 << depth) - 1
        self.normal = np.zeros((inner, x.shape[1]), dtype=np.float32)
        self.threshold = np.zeros(inner, dtype=np.float32)
        parts = [np.arange(len(x))]
        for level in range(depth):
            below = []
            for j, rows in enumerate(parts):
                node = (1 << level) - 1 + j
                normal, middle = self._direction(x, rows, rng)
                at = x[rows] @ normal
                half = len(rows) // 2
                if spread and len(rows):
                    below_ = int((at < middle).sum())
                    half = min(max(below_, int((0.5 - spread) * len(rows))), int((0.5 + spread) * len(rows)))
                order = np.argpartition(at, half) if 0 < half < len(rows) else np.arange(len(rows))
                self.normal[node] = normal
                self.threshold[node] = at[order[half]] if len(rows) else 0.0
                below += [rows[order[:half]], rows[order[half:]]]
            parts = below
        self.leaves = parts

    @classmethod
    def of(cls, depth: int, normal: bytes, threshold: bytes) -> Tree:
        """A tree without its leaves, from its hyperplanes."""
        tree = cls.__new__(cls)
        tree.depth, tree.leaves = depth, []
        tree.threshold = np.frombuffer(threshold, dtype=np.float32)
        tree.normal = np.frombuffer(normal, dtype=np.float32).reshape(len(tree.threshold), -1)
        return tree

    @staticmethod
    def _direction(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, sample: int = 48) -> tuple[np.ndarray, float]:
        """The normal of a hyperplane between two centres, and where their middle lies on it."""
        some = x[rows[rng.integers(0, len(rows), sample)]] if len(rows) else np.zeros((2, x.shape[1]), np.float32)
        a, b = some[0], some[-1]
        for _ in range(3):
            near = some @ (a - b) > 0.5 * (a @ a - b @ b)
            if near.all() or not near.any():
                break
            a, b = some[near].mean(0), some[~near].mean(0)
        normal = a - b
        norm = np.sqrt(normal @ normal)
        if norm < 1e-6:
            normal = rng.standard_normal(x.shape[1]).astype(np.float32)
            norm = np.sqrt(normal @ normal)
        normal = (normal / norm).astype(np.float32)
        return normal, float(0.5 * (a + b) @ normal)

    def priorities(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves): the smallest signed margin on the path to each leaf."""
        margin = q @ self.normal.T - self.threshold
        out = np.full((len(q), 1), np.inf, dtype=np.float32)
        for level in range(self.depth):
            first = (1 << level) - 1
            m = margin[:, first : first + (1 << level)]
            out = np.stack([np.minimum(out, -m), np.minimum(out, m)], axis=2).reshape(len(q), -1)
        return out


def forest(x: np.ndarray, trees: int, leaf_rows: int, seed: int) -> list[Tree]:
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf_rows))))
    rng = np.random.default_rng(seed)
    return [Tree(x, depth, rng) for _ in range(trees if depth else 1)]


def visits(trees: list[Tree], q: np.ndarray, edges: list[int]) -> np.ndarray:
    """(queries, edges[-1]): the leaves, over all trees, that the shared queue yields first.

    Those up to every edge come before the others; within a round their order doesn't matter.
    """
    out = []
    for lo in range(0, len(q), BLOCK):
        queue = np.concatenate([t.priorities(q[lo : lo + BLOCK]) for t in trees], axis=1)
        np.negative(queue, out=queue)
        kth = [e - 1 for e in edges if e < queue.shape[1]]
        order = np.argpartition(queue, kth, axis=1) if kth else np.tile(np.arange(queue.shape[1]), (len(queue), 1))
        out.append(order[:, : edges[-1]].astype(np.int32))
    return np.concatenate(out)


def visits_needed(trees: list[Tree], x: np.ndarray, k: int, seed: int) -> int:
    """How many leaves the shared queue must yield for VISIT_RECALL of the true neighbours of some rows."""
    rng = np.random.default_rng(seed)
    some = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    queue = np.concatenate([t.priorities(x[some]) for t in trees], axis=1)
    place = np.argsort(np.argsort(-queue, axis=1, kind="stable"), axis=1)
    first = np.full(near.shape, queue.shape[1], dtype=np.int64)
    leaf_of = np.empty(len(x), dtype=np.int64)
    offset = 0
    for t in trees:
        for i, rows in enumerate(t.leaves):
            leaf_of[rows] = offset + i
        first = np.minimum(first, np.take_along_axis(place, leaf_of[near], axis=1))
        offset += len(t.leaves)
    return int(np.quantile(first, VISIT_RECALL, method="higher")) + 1


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def unit32(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.float32)
    for lo in range(0, len(x), 8 * BLOCK):
        out[lo : lo + 8 * BLOCK] = unit(x[lo : lo + 8 * BLOCK])
    return out


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    return np.clip(np.einsum("nd,nd->n", q, x) / np.sqrt((q * q).sum(1) * (x * x).sum(1)), -1.0, 1.0)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, similarity): the k best of the rows x for each query, without the query itself."""
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)
    if not len(x) or not len(q):
        return empty
    x32 = unit32(x)
    q32 = x32 if q is x else unit32(q)
    trees = forest(x32, TREES, LEAF_ROWS, seed)
    leaves = [rows for t in trees for rows in t.leaves]
    count = visits_needed(trees, x32, k, seed) if len(x) > 1 else 1
    edges = [min(FIRST, count)]
    while edges[-1] < count:
        edges.append(min(GROW * edges[-1], count))
    parts = []
    for lo in range(0, len(q), QUERIES):
        qs, own = q32[lo : lo + QUERIES], q_ids[lo : lo + QUERIES]
        who, rows = _candidates(x32, ids, qs, own, leaves, visits(trees, qs, edges), edges, k + EXTRA)
        sim = np.concatenate([_cosine(q[lo + who[i : i + 65_536]], x[rows[i : i + 65_536]]) for i in range(0, len(who), 65_536)] or [np.empty(0)])
        order = np.lexsort((ids[rows], -sim, who))
        who, rows, sim = who[order], rows[order], sim[order]
        kept = _place(who) < k
        parts.append((own[who[kept]], ids[rows[kept]], sim[kept]))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else empty


def _place(who: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its query; entries of a query stand together."""
    at = np.arange(len(who))
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else at
    return at - np.repeat(starts, np.diff(np.append(starts, len(who))))


def _candidates(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, leaves: list[np.ndarray], chosen: np.ndarray, edges: list[int], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row): the best rows of the visited leaves. After every round only what beats the best so far is added."""
    least = np.full(len(q), -np.inf, dtype=np.float32)
    who, rows, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    for begin, end in zip([0, *edges[:-1]], edges):
        visited = chosen[:, begin:end].ravel()
        order = np.argsort(visited, kind="stable")
        bounds = np.searchsorted(visited[order], np.arange(len(leaves) + 1))
        order //= end - begin
        found = [(who, rows, score)]
        for leaf in np.flatnonzero(np.diff(bounds)):
            inside = leaves[leaf]
            if not len(inside):
                continue
            asking = order[bounds[leaf] : bounds[leaf + 1]]
            s = q[asking] @ x[inside].T
            if not begin and len(inside) > keep + 1:  # the first round has no bound yet but that of the leaf
                bound = np.partition(s, len(inside) - keep - 1, axis=1)[:, len(inside) - keep - 1 : len(inside) - keep]
                i, j = np.nonzero(s >= bound)
            else:
                i, j = np.nonzero(s >= least[asking][:, None])
            found.append((asking[i], inside[j], s[i, j]))
        who, rows, score = (np.concatenate(c) for c in zip(*found))
        _, once = np.unique(who * len(x) + rows, return_index=True)
        once = once[ids[rows[once]] != own[who[once]]]
        order = np.lexsort((ids[rows[once]], -score[once], who[once]))
        once = once[order]
        once = once[_place(who[once]) < keep]
        who, rows, score = who[once], rows[once], score[once]
        full = np.flatnonzero(_place(who) == keep - 1)
        least[who[full]] = score[full]
    return who, rows


def usable(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """index_name, vec_id, embedding of the vectors that take part."""
    rows = latest(vectors.where("vec_id is not null").select("vec_id", "index_name", "embedding", "ingested_at"), ["vec_id"], "ingested_at", "index_name", "embedding")
    return _fitting(rows, meta)


def _fitting(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Vectors as wide as their index says, finite and not zero."""
    dims = meta.groupBy("index_name").agg(F.max("dimensions").alias("_width")).withColumnRenamed("index_name", "_index")
    rows = rows.join(dims, (F.col("index_name") == F.col("_index")) & (F.size("embedding") == F.col("_width")), "inner")
    return rows.where(_sound()).select("index_name", "vec_id", "embedding")


def _sound() -> Column:
    """All elements finite, and not all zero."""
    return F.forall("embedding", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _routers(rows: DataFrame, counts: dict[str, int]) -> dict[str, tuple[Tree, int]]:
    """(coarse tree, shards to ask) of the indexes that are larger than a shard, each fitted by a task of its own."""
    depths = {name: int(np.ceil(np.log2(n / SHARD_ROWS))) for name, n in counts.items()}
    shares = rows.sparkSession.createDataFrame([(name, int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))) for name, n in counts.items()], "index_name string, _share bigint")
    picked = rows.join(F.broadcast(shares), "index_name").where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) < F.col("_share"))

    def fit(t: pa.Table) -> pa.Table:
        name = t.column("index_name")[0].as_py()
        x = unit32(_matrix(t.column("embedding")))
        tree = Tree(x, min(depths[name], int(np.log2(max(2, len(x) / 8)))), np.random.default_rng(7), SPREAD)
        return pa.table({"index_name": [name], "depth": pa.array([tree.depth], pa.int32()), "asked": pa.array([_shards_to_ask(tree, x)], pa.int32()), "normal": [tree.normal.tobytes()], "threshold": [tree.threshold.tobytes()]})

    fitted = picked.select("index_name", "embedding").groupBy("index_name").applyInArrow(fit, "index_name string, depth int, asked int, normal binary, threshold binary")
    return {r["index_name"]: (Tree.of(r["depth"], bytes(r["normal"]), bytes(r["threshold"])), r["asked"]) for r in fitted.collect()}


def _shards_to_ask(tree: Tree, x: np.ndarray, k: int = 5, queries: int = 500) -> int:
    """The first shards of a query's queue that hold ROUTE_RECALL of its nearest rows in the sample."""
    q = x[:queries]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1 << tree.depth
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    home = np.concatenate([tree.priorities(x[i : i + BLOCK]).argmax(1) for i in range(0, len(x), BLOCK)])
    place = np.argsort(np.argsort(-tree.priorities(q), axis=1), axis=1)  # of each shard in the queue
    return int(np.quantile(np.take_along_axis(place, home[near], axis=1), ROUTE_RECALL, method="higher")) + 1


def _route(rows: DataFrame, routers: dict[str, tuple[Tree, int]]) -> DataFrame:
    """A row per shard in which a vector is stored or asks."""
    schema = "index_name string, vec_id bigint, embedding array<float>, shard int, stored boolean"

    def route(batches):
        for batch in batches:
            index = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in set(index):
                at = np.flatnonzero(index == name)
                part = batch.take(pa.array(at))
                if name not in routers:
                    yield _routed(part, np.arange(len(at)), np.zeros(len(at), np.int32), np.ones(len(at), bool))
                    continue
                tree, asked = routers[name]
                order = np.argsort(-tree.priorities(unit32(_matrix(part.column(2)))), axis=1, kind="stable")[:, :asked]
                stored = np.tile(np.arange(order.shape[1]) == 0, (len(at), 1))
                yield _routed(part, np.repeat(np.arange(len(at)), order.shape[1]), order.ravel().astype(np.int32), stored.ravel())

    return rows.select("index_name", "vec_id", "embedding").mapInArrow(route, schema)


def _routed(part: pa.RecordBatch, rows: np.ndarray, shard: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
    taken = part.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard, pa.int32()), pa.array(stored)], names=["index_name", "vec_id", "embedding", "shard", "stored"])


def _grid(routed: DataFrame) -> DataFrame:
    """The rows with their part of the shard, and whether they are stored (``stored``) and ask (``asks``) there.

    A shard of more than twice the limit is a grid of sub-shards × blocks of queries.
    """
    parts = lambda n: F.ceil(n / SHARD_ROWS).cast("int")
    sizes = routed.groupBy("index_name", "shard").agg(F.count_if("stored").alias("own"), F.count("*").alias("asking")).where(F.greatest("own", "asking") > 2 * SHARD_ROWS)
    hot = checkpointed(sizes.select("index_name", "shard", F.greatest(F.lit(1), parts(F.col("own"))).alias("rows"), parts(F.col("asking")).alias("columns")))  # at most rows sent / SHARD_ROWS
    if hot.isEmpty():
        return routed.withColumn("part", F.lit(0)).withColumn("asks", F.lit(True))
    marked = routed.join(F.broadcast(hot), ["index_name", "shard"], "left")
    plain = marked.where("rows is null").withColumn("part", F.lit(0)).withColumn("asks", F.lit(True))
    crowded = marked.where("rows is not null")
    row, column = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("rows")).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(8)), F.col("columns")).cast("int")
    own = crowded.where("stored").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: row * F.col("columns") + j))).withColumn("asks", F.lit(False))
    asking = crowded.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: i * F.col("columns") + column))).withColumn("asks", F.lit(True)).withColumn("stored", F.lit(False))
    return plain.unionByName(own).unionByName(asking).drop("rows", "columns")


def nearest(vectors: DataFrame, meta: DataFrame, k: int = 5) -> DataFrame:
    """vec_id, neighbor_id, rank, similarity (cosine) of the k most similar vectors of the same index."""
    rows = usable(vectors, meta)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double") * e))
    # the norm stands in an array of its own, so that it is computed once a row
    whole = F.zip_with("embedding", F.array_repeat(norm, F.size("embedding")), lambda e, n: F.rint(e / n * 1e6).cast("long"))
    copy = F.xxhash64("index_name", whole)
    crowded = vectors.where(_sound()).groupBy("index_name", copy.alias("copy")).agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    crowded = checkpointed(crowded.select("index_name", "copy"))
    direct = None
    if not crowded.isEmpty():
        rows = checkpointed(rows.withColumn("copy", copy))
        same = rows.select("index_name", "copy", "vec_id").join(crowded, ["index_name", "copy"], "left_semi")
        first = same.withColumn("no", F.row_number().over(Window.partitionBy("index_name", "copy").orderBy("vec_id"))).where(F.col("no") <= k + 1)
        first = checkpointed(first.groupBy("index_name", "copy").agg(F.sort_array(F.collect_list("vec_id")).alias("first")))
        placed = join_crowded(rows, first, ["index_name", "copy"])
        searched = placed.where(F.col("first").isNull() | F.array_contains("first", F.col("vec_id")))
        others = placed.where(F.col("first").isNotNull() & ~F.array_contains("first", F.col("vec_id")))
        direct = others.select("vec_id", F.explode(F.slice("first", 1, k)).alias("neighbor_id"), F.lit(1.0).alias("similarity"))
        rows = searched.select("index_name", "vec_id", "embedding")

    big = vectors.groupBy("index_name").count().where(F.col("count") > SHARD_ROWS).where("index_name is not null").collect()  # at most total / SHARD_ROWS rows
    counts = {r["index_name"]: r["count"] for r in big}
    if counts:
        routed = _grid(_route(rows, _routers(_fitting(vectors, meta), counts)))
    else:
        routed = rows.select("index_name", "vec_id", "embedding", F.lit(0).alias("shard"), F.lit(0).alias("part"), F.lit(True).alias("stored"), F.lit(True).alias("asks"))

    def one(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t.column("embedding")), t.column("vec_id").to_numpy()
        stored, asks = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("stored", "asks"))
        own = (x, ids) if stored.all() else (x[stored], ids[stored])
        asking = (x, ids) if asks.all() else (x[asks], ids[asks])
        a, b, s = search(*own, *asking, k)
        return pa.table({"vec_id": a, "neighbor_id": b, "similarity": s})

    pairs = routed.groupBy("index_name", "shard", "part").applyInArrow(one, "vec_id bigint, neighbor_id bigint, similarity double")
    if direct is not None:
        pairs = pairs.unionByName(direct)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "similarity")


def similar_pairs(neighbours: DataFrame, least: float = 0.85) -> DataFrame:
    """Unordered pairs of at least that similarity of which one is among the nearest of the other."""
    pair = neighbours.where(F.col("similarity") >= least)
    return pair.select(F.least("vec_id", "neighbor_id").alias("vec_id_a"), F.greatest("vec_id", "neighbor_id").alias("vec_id_b")).distinct()
