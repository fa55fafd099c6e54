"""Weighted fusion of vector and BM25 scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-6


def minmax(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.greatest(high - low, F.lit(FLOOR))


def fuse(candidates: DataFrame, bm25: DataFrame, alpha: float, key: str) -> DataFrame:
    """(key, score, rank) of the candidates (key, score): α · vector + (1 − α) · BM25, each scaled to 0..1.

    Vector scores are scaled over the candidates, BM25 scores (key, score) over all documents; a candidate without
    BM25 score has 0. Ties go to the better vector score, then the smaller key.
    """
    span = bm25.agg(F.struct(F.min("score").alias("low"), F.max("score").alias("high")))
    near = candidates.agg(F.struct(F.min("score").alias("low"), F.max("score").alias("high")))
    rows = candidates.select(key, F.col("score").alias("_v")).join(bm25.select(key, F.col("score").alias("_b")), key, "left")
    rows = rows.withColumn("_n", near.scalar()).withColumn("_a", span.scalar())
    vector = minmax(F.col("_v"), F.col("_n.low"), F.col("_n.high"))
    text = minmax(F.coalesce(F.col("_b"), F.lit(0.0)), F.coalesce(F.col("_a.low"), F.lit(0.0)), F.coalesce(F.col("_a.high"), F.lit(0.0)))
    fused = rows.select(key, "_v", (alpha * vector + (1 - alpha) * text).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), F.desc("_v"), key))).select(key, "score", "rank")


def candidates_of(vector_hits: DataFrame, bm25_hits: DataFrame, key: str) -> DataFrame:
    """(key, score): the vector hits, and the BM25 hits that are not among them with vector score 0."""
    more = bm25_hits.select(key).join(vector_hits.select(key), key, "left_anti").withColumn("score", F.lit(0.0))
    return vector_hits.select(key, "score").unionByName(more)
