"""The search request: filter, vector ranking, hybrid fusion, late materialisation.

Filters are applied before ranking, so k results come out if there are k; ``post_filter`` ranks five times as many
first and filters afterwards, which may return fewer. Text and metadata are joined to the k hits only at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import bm25, hybrid, vectors
from plumbline.operators.filters import Json, Tree, Typed, compile_filter

OVERFETCH = 5


@dataclass(frozen=True)
class SearchOptions:
    """``fusion_input``: "score" feeds the dot product to the fusion; "distance" feeds 1 − dot as the original does."""

    top_k: int = 5
    complexity: int = 64
    filter: Tree | str | dict | None = None
    hybrid: bool = False
    hybrid_alpha: float = 0.7
    query_text: str | None = None
    auto_hybrid: bool = False
    post_filter: bool = False
    fusion_input: str = "score"


def wants_hybrid(options: SearchOptions) -> bool:
    """Hybrid if asked for, or for queries of three words or fewer; never without query text."""
    text = options.query_text
    return bool(text) and (options.hybrid or options.auto_hybrid and len(text.split()) <= 3)


def search(passages: DataFrame, embeddings: DataFrame, query: Sequence[float], options: SearchOptions, key: str = "id", text: str = "text", binding: Typed | Json | None = None, index: vectors.InvertedFile | None = None, terms: bm25.TermIndex | None = None) -> DataFrame:
    """The columns of passages with score and rank.

    ``embeddings`` is (key, embedding); an ``index`` makes it approximate; with ``terms`` hybrid search reads the
    persisted statistics instead of the texts.
    """
    k = options.top_k
    fused = wants_hybrid(options)
    keep = None
    if options.filter is not None:
        keep = passages.where(compile_filter(options.filter, binding or Typed(passages)))
    early = keep is not None and not options.post_filter
    pool = keep if early else passages
    fetch = k * OVERFETCH if fused or (keep is not None and not early) else k
    if index is not None and not early:
        hits = index.search(query, fetch, options.complexity).select(key, "score")
    else:
        hits = vectors.top_k(embeddings.join(pool.select(key), key, "left_semi") if early else embeddings, query, fetch, key).select(key, "score")
    if fused:
        scores = terms.scores(options.query_text, pool if early else None) if terms else bm25.scores(pool, options.query_text, key, text, materialize=True)
        best = scores.where("score > 0").orderBy(F.desc(F.round("score", 9)), key).limit(fetch)
        if options.fusion_input == "distance":
            hits = hits.withColumn("score", 1.0 - F.col("score"))
        hits = hybrid.fuse(hybrid.candidates_of(hits, best, key), scores, options.hybrid_alpha, key).select(key, "score", "rank")
    else:
        hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    # hits are bounded by fetch; a passage that is missing drops its hit
    rows = (keep if keep is not None else passages).join(F.broadcast(hits.where(F.col("rank") <= fetch * 2)), key, "inner")
    again = F.row_number().over(Window.orderBy("rank"))
    return rows.withColumn("rank", again).where(F.col("rank") <= k)


def recompute_search(passages: DataFrame, query: Sequence[float], embed, k: int, key: str = "id", text: str = "text", filter: Tree | str | dict | None = None, binding: Typed | Json | None = None) -> DataFrame:
    """For indexes without stored vectors: filter, embed what remains, rank exactly. ``embed``: column name -> Column."""
    pool = passages if filter is None else passages.where(compile_filter(filter, binding or Typed(passages)))
    hits = vectors.top_k(pool.select(key, embed(text).alias("embedding")), query, k, key).select(key, "score", "rank")
    return pool.join(F.broadcast(hits), key, "inner")
