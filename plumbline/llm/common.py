"""Shared pieces of the training-data operators: tables, checkpoints, latest arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ids import checkpointed
from plumbline.sources.tables import table

__all__ = ["checkpointed", "join_crowded", "latest", "table"]

CROWD = 100_000


def latest(df: DataFrame, keys: list[str], arrived: str, *payload: str) -> DataFrame:
    """One row per key: that of the latest arrival. Null arrivals count as oldest.

    Ties are broken by a hash of the payload, so the choice doesn't depend on the order of rows.
    """
    order = F.struct(F.coalesce(F.col(arrived).cast("timestamp"), F.timestamp_micros(F.lit(0).cast("long"))), F.xxhash64(*payload))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[p].alias(p) for p in payload])


def join_crowded(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``many`` with ``one``, which has a row per key and is cheap to read, on keys that may be crowded.

    Keys with more than CROWD rows, of which there are at most rows / CROWD, get their row by broadcast, so their rows
    stay where they are; the others are shuffled.
    """
    crowded = checkpointed(many.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select(*keys, F.lit(True).alias("_crowded")))
    if crowded.isEmpty():
        return many.join(one, keys, "left")
    marked = many.join(F.broadcast(crowded), keys, "left")
    hot = one.join(F.broadcast(crowded), keys, "left_semi")
    by_broadcast = marked.where("_crowded").drop("_crowded").join(F.broadcast(hot), keys, "left")
    return by_broadcast.unionByName(marked.where("_crowded is null").drop("_crowded").join(one, keys, "left"))
