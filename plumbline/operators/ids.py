"""Running numbers over a distributed order, without sorting in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where none is set a temporary one is used on a local master, and removed at the end; a cluster needs a shared one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, create: bool = True) -> str:
    """A new folder, or only its path, beside the checkpoints, for tables that are written and read again."""
    folder = f"{_checkpoint_dir(spark)}/tree-{uuid4().hex}"
    if create:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return folder


def counted(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Adds a BIGINT that counts the rows in the order of partitions and of rows in them.

    The number of rows of each partition (as many rows as partitions) gives the offsets.
    """
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = checkpointed(placed)
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    offset, offsets = start, []
    for part in sorted(sizes):
        offsets.append((part, offset))
        offset += sizes[part]
    if not offsets:
        return placed.drop("_part", "_row").withColumn(name, F.lit(None).cast("long"))
    firsts = F.create_map(*[F.lit(x).cast("long") for kv in offsets for x in kv])
    return placed.withColumn(name, firsts[F.col("_part").cast("long")] + F.col("_row")).drop("_part", "_row")


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Adds a BIGINT that counts from start in the order of the columns.

    Rows are range-partitioned and sorted, so no task sees more than its own range.
    """
    return counted(df.repartitionByRange(*order).sortWithinPartitions(*order), name, start)
