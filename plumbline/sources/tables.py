"""Tables of a folder, spread over the cores where they come in too few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, by: str | None = None) -> DataFrame:
    """A table. With ``by``, one that comes in fewer splits than there are cores is spread over the cores by that key.

    Only small tables come in so few splits; for them the exchange is cheap against the work on their texts.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, by) if by and df.rdd.getNumPartitions() < cores else df
