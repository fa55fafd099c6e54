"""Problem 4: chunks whose sets of distinct words are similar, by tensored banding of minhashes.

Two small collections of half keys are made from each set: ``TABLES`` half keys A_i and as many B_j, each of
``HALF`` minhashes. Table (i, j) of the tensored scheme has the key (A_i, B_j): TABLES² tables with keys of
2·HALF minhashes, for the price of 2·TABLES·HALF minhashes. With similarity s the two sets meet in some table with
probability (1 − (1 − s^HALF)^TABLES)²: 0.97 at 0.7, 0.99 at 0.75, over 0.999 from 0.85. Rows aren't sent to every
table: each goes to its TABLES half keys A_i and carries its B minhashes, and the tables (i, ·) of a bucket are
formed where the bucket is processed. A bucket of A_i that exceeds ``BUCKET_ROWS`` is divided by its full keys
(A_i, B_j), and one that is still too large into pairs of blocks (rows of one block meet in the block's own bucket
only), so a key that a third of all rows share never comes into one task, and nothing is cut.
Members of a table are compared by their B minhashes (8 bits each) and candidates verified exactly on the words.

Copies: chunks with the same set of words are one class and one row of the search. Links are found between class
representatives; the pairs that the query's columns ask for come from joining these links with the members. A class
of n copies has n(n − 1)/2 such pairs, which is the size of that output; the members of a class come in blocks of at
most about ``MEMBERS``, and every two blocks are joined by themselves, so the work on a large class is spread.
``similar_classes`` gives classes and links without pairs of copies.

Defined cases: words are maximal runs of ASCII letters and digits, lower-cased, of two or more characters; null
texts and texts without words take no part; of a repeated chunk_id the latest arrival counts; empty tables give no
rows. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, join_crowded, latest

TABLES, HALF = 10, 3
LEAST = 0.7
SCREEN = 0.42  # of the B minhashes must agree before words are compared; 0.7 fails that once in about 3,000 pairs
BUCKET_ROWS = 20_000
MEMBERS = 2_000
BLOCK = 512

WORDS = re.compile(rb"[a-z0-9]{2,}")
_A = np.random.default_rng(404).integers(1, 1 << 62, 2 * TABLES * HALF, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(405).integers(0, 1 << 62, 2 * TABLES * HALF, dtype=np.uint64)


def word_set(text: str) -> set[bytes]:
    return set(WORDS.findall(text.encode("utf-8", "replace").lower()))


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def minhashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, functions): 32-bit minhashes; the values of set i begin at starts[i]."""
    out = np.empty((len(starts), len(_A)), dtype=np.uint32)
    for f in range(len(_A)):
        h = ((values * _A[f] + _B[f]) >> np.uint64(32)).astype(np.uint32)
        out[:, f] = np.minimum.reduceat(h, starts)
    return out


def half_keys(m: np.ndarray) -> np.ndarray:
    """(sets, TABLES) 32-bit keys from HALF minhashes each."""
    parts = m.reshape(len(m), TABLES, HALF).astype(np.uint64)
    key = np.full(parts.shape[:2], 0x9E3779B97F4A7C15, dtype=np.uint64)
    for j in range(HALF):
        key = (key ^ parts[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32)


_SIGNED = "chunk_id bigint, ingested_at timestamp, same bigint, same2 bigint, size int, a array<int>, b binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            sets = [word_set(t) if t else () for t in part.column(2).to_pylist()]
            values, starts, keep = [], [], []
            for i, s in enumerate(sets):
                if s:
                    keep.append(i)
                    starts.append(len(values))
                    for w in s:
                        h = known.get(w)
                        if h is None:
                            h = known[w] = _hash(w)
                        values.append(h)
            if len(known) > 400_000:
                known.clear()
            ids = part.select(["chunk_id", "ingested_at"]).take(pa.array(keep, pa.int64()))
            v, st = np.array(values, dtype=np.uint64), np.array(starts, dtype=np.int64)
            n = len(keep)
            if n:
                m = minhashes(v, st)
                a = half_keys(m[:, : TABLES * HALF]).view(np.int32)
                b = (m[:, TABLES * HALF :] & 0xFF).astype(np.uint8)
                same = np.add.reduceat(v * np.uint64(0x94D049BB133111EB), st).view(np.int64)
                same2 = np.bitwise_xor.reduceat(v ^ (v >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93), st).view(np.int64)
            else:
                a, b, same, same2 = np.zeros((0, TABLES), np.int32), np.zeros((0, TABLES * HALF), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TABLES), pa.array(a.ravel()))
            sizes = np.diff(np.append(st, len(v))).astype(np.int32) if n else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(same), pa.array(same2), pa.array(sizes), keys, pa.array([r.tobytes() for r in b], pa.binary())],
                names=["chunk_id", "ingested_at", "same", "same2", "size", "a", "b"],
            )


def signatures(chunks: DataFrame) -> DataFrame:
    """chunk_id, same and same2 (128 bits that name the set of words), size, a (half keys), b (minhash bytes)."""
    signed = chunks.where("chunk_id is not null and text is not null").select("chunk_id", "ingested_at", "text").mapInArrow(_sign, _SIGNED)
    return latest(signed, ["chunk_id"], "ingested_at", "same", "same2", "size", "a", "b")


def _meet(key: np.ndarray, ids: np.ndarray, size: np.ndarray, side: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Candidate pairs among the rows, which meet in a table if they agree in key and in one of the B half keys.

    Rows of one side of a bucket (1 or 2) don't meet each other, those of side 0 do.

    Pairs come in arrays of bounded size; one that meets in several tables may come several times.
    """
    parts = b.reshape(len(b), TABLES, HALF).astype(np.uint64)
    found: list[np.ndarray] = []
    held = 0
    for j in range(TABLES):
        own = key.astype(np.uint64).copy()
        for h in range(HALF):
            own = (own ^ (parts[:, j, h] + np.uint64(h + 1))) * np.uint64(0xBF58476D1CE4E5B9)
            own ^= own >> np.uint64(31)
        order = np.argsort(own, kind="stable")
        edges = np.flatnonzero(np.diff(own[order])) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(own))
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            rows = order[s:e]
            for lo in range(0, len(rows), BLOCK):
                x = rows[lo : lo + BLOCK]
                for hi in range(lo, len(rows), BLOCK):
                    y = rows[hi : hi + BLOCK]
                    near = (b[x][:, None, :] == b[y][None, :, :]).mean(2) >= SCREEN
                    near &= np.minimum(size[x][:, None], size[y][None, :]) >= LEAST * np.maximum(size[x][:, None], size[y][None, :]) - 1e-9
                    i, k = np.nonzero(near)
                    p, q = ids[x[i]], ids[y[k]]
                    ok = (p != q) & ((side[x[i]] == 0) | (side[x[i]] != side[y[k]]))
                    found.append(np.stack([np.minimum(p[ok], q[ok]), np.maximum(p[ok], q[ok])], 1))
                    held += len(found[-1])
            if held > 500_000:
                yield np.unique(np.concatenate(found), axis=0)
                found, held = [], 0
    if held:
        yield np.unique(np.concatenate(found), axis=0)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, and no bucket is large; whole buckets are taken together."""
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        b = np.frombuffer(b"".join(t.column("b").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        for pairs in _meet(t.column("bucket").to_numpy(), t.column("rep").to_numpy(), t.column("size").to_numpy(), t.column("side").to_numpy(), b):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < 50_000:
            continue
        t = pa.Table.from_batches(held)
        bucket = t.column("bucket").to_numpy()
        last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
        if last:
            yield from flush(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
            count = t.num_rows - last
    if count:
        yield from flush(pa.Table.from_batches(held))


def _crowded(keyed: DataFrame) -> DataFrame:
    """Buckets of more than BUCKET_ROWS rows (at most rows / BUCKET_ROWS), with the number of blocks they need."""
    counts = keyed.groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS)
    return checkpointed(counts.select("bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("blocks")))


def _divided(keyed: DataFrame) -> DataFrame:
    """The rows with buckets of bounded size.

    A crowded bucket of A_i is divided by the full keys (A_i, B_j). One that is still crowded is cut into blocks by
    a hash of the row, and every two blocks meet in a bucket of their own: the exact way, without a cap.
    """
    hot = _crowded(keyed)
    if hot.isEmpty():
        return keyed
    full = keyed.join(F.broadcast(hot.select("bucket")), "bucket", "left_semi").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))))
    full = full.withColumn("bucket", F.xxhash64("bucket", "j", F.substring("b", F.col("j") * HALF + 1, F.lit(HALF)))).select(*keyed.columns)
    plain = keyed.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti")
    still = _crowded(full)
    if not still.isEmpty():
        own = F.pmod(F.xxhash64("rep", F.lit(4)), F.col("blocks"))
        blocks = full.join(F.broadcast(still), "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        blocks = blocks.withColumn("side", side.cast("byte")).withColumn("bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).select(*keyed.columns)
        full = full.join(F.broadcast(still.select("bucket")), "bucket", "left_anti").unionByName(blocks)
    return plain.select(*keyed.columns).unionByName(full)


def class_links(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: chunk_id, rep, size; links: a < b, similarity): classes of equal sets and the links between them."""
    signed = checkpointed(signatures(chunks))
    classes = checkpointed(signed.groupBy("same", "same2").agg(F.min(F.struct("chunk_id", "size", "a", "b")).alias("r")))  # used three times
    reps = classes.select(F.col("r.chunk_id").alias("rep"), "r.size", "r.a", "r.b")
    keyed = reps.select("rep", "size", "b", F.posexplode("a").alias("i", "key")).select("rep", "size", "b", F.lit(0).cast("byte").alias("side"), F.xxhash64("i", "key").alias("bucket"))
    keyed = _divided(keyed)
    placed = keyed.repartition("bucket").sortWithinPartitions("bucket")
    found = placed.select("bucket", "rep", "size", "side", "b").mapInArrow(_candidates, "a bigint, b bigint").distinct()
    found = checkpointed(found)

    # exact verification: two rows for each candidate, each with its set of words
    wanted = found.select(F.explode(F.array("a", "b")).alias("chunk_id")).distinct()
    words = latest(chunks.where("text is not null").join(wanted, "chunk_id", "left_semi"), ["chunk_id"], "ingested_at", "text").mapInArrow(_word_rows, "chunk_id bigint, words array<bigint>")
    words = checkpointed(words)
    pairs = found.join(words.select(F.col("chunk_id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("chunk_id").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    both = pairs.select("a", "b", shared.alias("shared"), (F.size("wa") + F.size("wb") - shared).alias("either"))
    links = both.where(F.col("shared") * 10 >= F.col("either") * int(LEAST * 10)).select("a", "b", (F.col("shared") / F.col("either")).alias("similarity"))
    members = join_crowded(signed.select("chunk_id", "size", "same", "same2"), classes.select("same", "same2", F.col("r.chunk_id").alias("rep")), ["same", "same2"])
    return members.select("chunk_id", "rep", "size"), links


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [sorted(_hash(w) - (1 << 63) for w in word_set(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["chunk_id", "words"])


def similar_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id_a < chunk_id_b of all pairs: members of linked classes, and members of one class."""
    members, links = class_links(chunks)
    members = checkpointed(members.select("chunk_id", "rep"))
    # classes that need several blocks, at most rows / MEMBERS
    large = checkpointed(members.groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS).select("rep", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")))
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    numbered = members.join(F.broadcast(large), "rep", "left").select("chunk_id", "rep", F.pmod(F.xxhash64("chunk_id", F.lit(9)), blocks).cast("int").alias("block"))

    def side(x: str, rep: str, no: str) -> DataFrame:
        return numbered.select(F.col("chunk_id").alias(x), F.col("rep").alias(rep), F.col("block").alias(no))

    def counted(df: DataFrame, rep: str, no: str) -> DataFrame:
        """A row for each block of the class."""
        own = large.select(F.col("rep").alias(rep), "blocks")
        return df.join(F.broadcast(own), rep, "left").withColumn(no, F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")

    across = counted(counted(links.select("a", "b"), "a", "i"), "b", "j").join(side("x", "a", "i"), ["a", "i"]).join(side("y", "b", "j"), ["b", "j"]).select("x", "y")
    # within a class: every block with itself and with those after it
    several = members.where("chunk_id <> rep").select("rep").distinct()
    within = counted(counted(several, "rep", "i").withColumnRenamed("rep", "a"), "a", "j").where("i <= j")
    within = within.join(side("x", "a", "i"), ["a", "i"]).join(side("y", "a", "j"), ["a", "j"]).where("i < j or x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))


def similar_classes(chunks: DataFrame) -> DataFrame:
    """One row per chunk: chunk_id, class_id (smallest chunk with the same words), copies, links (of its class)."""
    members, links = class_links(chunks)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    members = checkpointed(members)
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    out = join_crowded(members, checkpointed(sizes.join(ends, "rep", "left")), ["rep"])
    return out.select("chunk_id", F.col("rep").alias("class_id"), "copies", F.coalesce(F.col("links"), F.lit(0).cast("long")).alias("links"))
