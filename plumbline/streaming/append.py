"""Continuous append (an extension: the original appends only by its update command).

A stream of documents (source, text) is chunked and embedded row by row, without state, and every micro-batch is
written to a folder named by its number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import embed as emb
from plumbline.operators.chunking import chunk_table


def stream_documents(spark: SparkSession, path: str, schema: str = "source string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def passages_of(docs: DataFrame, provider, size: int = 256, overlap: int = 128, strategy: str = "auto", prefix: str = "") -> DataFrame:
    """Chunks with vectors and a stable id: a hash of source, ordinal and text."""
    chunks = chunk_table(docs, ["source"], "text", "source", size, overlap, strategy)
    return chunks.select(F.xxhash64("source", "ordinal", "text").alias("id"), "*", emb.embed_column(provider, "text", prefix).alias("embedding"))


def append_stream(docs: DataFrame, target: str, checkpoint: str, provider, once: bool = True, **chunking) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        passages_of(batch, provider, **chunking).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    """All appended passages; one that came in several batches counts once."""
    return spark.read.parquet(target).dropDuplicates(["id"])
