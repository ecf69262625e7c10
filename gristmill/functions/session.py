"""What operators ask of the session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task groups, about.
TASK_ROWS = 500_000
#: Rows of which a task makes texts and splits them, about.
TASK_TEXTS = 50_000


def checkpoints(spark: SparkSession) -> None:
    """Keeps the folder that the session names; sets one only where none is set and all runs on this machine (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the session names, else (tests) its own of this machine."""
    checkpoints(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def dealt(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by a key to as many partitions as their number asks for, so that a task's share does not grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, rows.count() // task_rows), key)


def fine(spark: SparkSession, rows: int) -> None:
    """Shuffles begin with as many partitions as that many rows ask for; adaptive execution puts small ones together and still splits uneven joins."""
    name, least = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(name, str(max(least, int(spark.conf.get(name, None) or 0), rows // TASK_ROWS)))


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds Arrow batches by bytes, as ten thousand long texts in one would fill an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
