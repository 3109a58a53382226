"""Intermediate tables of iterative plans, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_BYTES = 16 << 20  # of stored input that one task groups: a hash table of them takes some 20 times as much
UNKNOWN_BYTES = 1 << 60  # Spark's size for rows that it can't measure


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as often as it reads them. Nothing is run for it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` before it is grouped or joined by them, over tasks that grow in number and not in size with its input.

    For keys that rarely repeat: the map side keeps no table of them, which wouldn't shrink them. A small input is
    left to the session's number of partitions and to adaptive execution.
    """
    parts = -(-stored_bytes(df) // TASK_BYTES)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: its lineage ends here, and losing an executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
