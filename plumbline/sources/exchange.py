"""Import and export of the line-based index format: passages as JSON lines, ids by line, a raw f32 matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ids import counted

PASSAGE = "id string, text string, metadata string"


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """id, text, metadata (JSON string; 'null' where absent). Of repeated ids the last line counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    v = F.try_parse_json("value")
    rows = lines.where(v.isNotNull()).select(
        F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.text", "string").alias("text"),
        F.coalesce(F.to_json(F.try_variant_get(v, "$.metadata", "variant")), F.lit("null")).alias("metadata"), "line",
    )
    return rows.groupBy("id").agg(F.max_by(F.struct("text", "metadata"), "line").alias("r")).select("id", "r.text", "r.metadata")


def write_passages(passages: DataFrame, path: str) -> None:
    meta = F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("null")))
    passages.select(F.to_json(F.struct("id", "text", meta.alias("metadata"))).alias("value")).write.mode("errorifexists").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """ordinal (from 0), id of one file: line numbers are positions in the index."""
    return counted(spark.read.text(path).select(F.col("value").alias("id")), "ordinal").select("ordinal", "id")


def read_matrix(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """ordinal, embedding of a headerless matrix of 32-bit floats. A size that is no multiple of a row is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                if len(raw) % (4 * dimensions):
                    raise ValueError(f"{len(raw)} bytes are no whole rows of {dimensions} floats")
                m = np.frombuffer(raw, dtype="<f4").reshape(-1, dimensions)
                for lo in range(0, len(m), 10_000):
                    part = m[lo : lo + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dimensions), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part), dtype=np.int64)), lists], names=["ordinal", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "ordinal bigint, embedding array<float>")


def write_matrix(vectors: DataFrame, folder: str) -> None:
    """(ordinal, embedding) as parts of a raw matrix: a row per block of 1,024 ordinals, so no task holds the whole."""

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("ordinal")
        column = t.column("embedding").combine_chunks()
        return pa.table({"first": pa.array([t.column("ordinal")[0].as_py()], pa.int64()), "content": pa.array([column.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()], pa.binary())})

    rows = vectors.withColumn("block", F.floor(F.col("ordinal") / 1024)).groupBy("block").applyInArrow(block, "first bigint, content binary")
    rows.write.mode("errorifexists").parquet(folder)


def read_parts(spark: SparkSession, folder: str, dimensions: int) -> DataFrame:
    """ordinal, embedding of the parts that write_matrix wrote; the parts are read by many tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = np.frombuffer(raw, dtype="<f4").reshape(-1, dimensions)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dimensions), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(m), dtype=np.int64)), lists], names=["ordinal", "embedding"])

    return spark.read.parquet(folder).select("first", "content").mapInArrow(rows, "ordinal bigint, embedding array<float>")


def foreign_format(head: bytes) -> str | None:
    """Name of a vector-index format that this library doesn't read, by its first bytes."""
    # Magic bytes.
    if head[:2] == b"Ix" or head[:4] in (b"CSR\0", b"HNSW"):
        return "faiss"
    return None


def positions_to_ids(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """hits (ordinal, ...) with their id; a position without id gives its number."""
    return hits.join(ids, "ordinal", "left").withColumn("id", F.coalesce("id", F.col("ordinal").cast("string")))
