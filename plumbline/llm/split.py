"""Problem 1: cut items that exceed a byte limit into overlapping pieces at natural boundaries.

A token is four bytes, as in ``chunker_settings``. For one text the operator lays the byte offsets of all
characters out as prefix sums, collects the offsets at which a piece may end (paragraph, line, sentence, word,
each level a sorted array), and finds every cut with a binary search for the last boundary under the limit. The
strongest level wins that leaves the piece at least half full; if only word ends are left, any word end does;
with none the cut is hard, at the last whole character under the limit. The next piece starts ``overlap`` tokens
before the cut, moved back to a whole character.

Defined cases: null text is no item; a null size means 256 and a null overlap 128 tokens; a size under one token
counts as one; a negative overlap counts as none; an overlap that is as large as the size or larger cannot be
repeated by pieces that keep the limit, so it counts as half the size. A character longer than the limit cannot
occur, since the smallest limit is four bytes. Of a repeated item the latest arrival counts. Empty tables give
no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import latest

TOKEN_BYTES = 4
DEFAULT_SIZE, DEFAULT_OVERLAP = 256, 128

#: What a piece may end after, strongest first.
LEVELS = [
    ("paragraph", re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")),
    ("line", re.compile(r"\r?\n|\r")),
    ("sentence", re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]")),
    ("word", re.compile(r"\s+")),
]


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Byte ranges ``(start, end, kind)`` of the pieces; kind is the level of the cut that ends the piece."""
    limit = max(limit, TOKEN_BYTES)
    overlap = max(overlap, 0)
    if overlap >= limit:
        overlap = limit // 2
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = len(raw)
    if total <= limit:
        return [(0, total, "end")]
    starts = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of every character
    offsets = np.append(starts, total)
    levels = [(name, offsets[[m.end() for m in rx.finditer(text)]].tolist()) for name, rx in LEVELS]
    chars = offsets.tolist()

    def whole(at: int) -> int:
        return chars[bisect_right(chars, at) - 1]

    pieces, start = [], 0
    while total - start > limit:
        least = max(start + overlap, pieces[-1][1] if pieces else 0)
        cut, kind = 0, "hard"
        for name, ends in levels:
            at = bisect_right(ends, start + limit) - 1
            floor = least if name == "word" else max(least, start + limit // 2)
            if at >= 0 and ends[at] > floor:
                cut, kind = ends[at], name
                break
        if not cut:
            cut = whole(start + limit)
            if pieces and cut <= pieces[-1][1]:  # the limit holds nothing but the overlap and a part of a character
                start = pieces[-1][1]
                continue
        pieces.append((start, cut, kind))
        back = whole(cut - overlap) if overlap else cut
        # a hard cut may fall short of the limit by a part of a character: then the overlap shrinks by it
        start = back if back > start else chars[bisect_right(chars, start)]
    pieces.append((start, total, "end"))
    return pieces


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, ids, texts, limits, overlaps = (batch.column(i).to_pylist() for i in range(5))
        out: dict[str, list] = {k: [] for k in ("item_kind", "item_id", "piece_no", "start_byte", "end_byte", "cut", "piece")}
        size = 0
        for kind, item, text, limit, overlap in zip(kinds, ids, texts, limits, overlaps):
            raw = text.encode("utf-8", "surrogatepass")
            for no, (a, b, how) in enumerate(cut_text(text, limit, overlap)):
                for k, v in zip(out, (kind, item, no, a, b, how, raw[a:b].decode("utf-8", "replace"))):
                    out[k].append(v)
                size += b - a
            if size > 16 << 20:
                yield _arrow(out)
                out, size = {k: [] for k in out}, 0
        yield _arrow(out)


_PIECES = "item_kind string, item_id bigint, piece_no int, start_byte bigint, end_byte bigint, cut string, piece string"
_ARROW = pa.schema([("item_kind", pa.string()), ("item_id", pa.int64()), ("piece_no", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("cut", pa.string()), ("piece", pa.string())])


def _arrow(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _ARROW], schema=_ARROW)


def items_of(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """The texts of chunks and the contents of code blocks as one table of items."""
    a = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "index_name", "text", "ingested_at")
    b = blocks.select(F.lit("block").alias("item_kind"), F.col("block_id").alias("item_id"), "index_name", F.col("content").alias("text"), "ingested_at")
    return a.unionByName(b)


def with_limits(items: DataFrame, settings: DataFrame, key: str = "index_name") -> DataFrame:
    """Adds limit_bytes and overlap_bytes; an item of an index without settings gets the defaults."""

    def tokens(c: str, default: int, least: int) -> Column:
        return F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(default)), F.lit(least)) * TOKEN_BYTES

    own = settings.groupBy(F.col(key).alias("_key")).agg(F.max("chunk_size").alias("_size"), F.max("chunk_overlap").alias("_overlap"))
    joined = items.join(own, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("limit_bytes", tokens("_size", DEFAULT_SIZE, 1)).withColumn("overlap_bytes", tokens("_overlap", DEFAULT_OVERLAP, 0)).drop("_key", "_size", "_overlap")


def split_oversized(items: DataFrame, settings: DataFrame) -> DataFrame:
    """All pieces of the items (item_kind, item_id, index_name, text, ingested_at) that exceed their limit.

    Texts under the limit leave the plan in the scan's stage; only oversized ones are shuffled, by their key,
    to keep the latest arrival, and reach Python.
    """
    sized = with_limits(items, settings).where("text is not null and item_id is not null")
    over = F.octet_length("text") > F.col("limit_bytes")
    kept = sized.withColumn("text", F.when(over, F.col("text")))
    one = latest(kept, ["item_kind", "item_id"], "ingested_at", "text", "limit_bytes", "overlap_bytes")
    return one.where("text is not null").select("item_kind", "item_id", "text", "limit_bytes", "overlap_bytes").mapInArrow(_cut_batches, _PIECES)
