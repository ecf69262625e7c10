"""Streaming extensions: windowed counts, sessions and idempotent ingest."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import index


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows; later rows than `late` are left out by the watermark."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ingest_once(chunks: DataFrame, time: str = "ts", key: str = "content_hash", late: str = "1 day") -> DataFrame:
    """Rows whose key has not come within the watermark."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def index_stream(items: DataFrame, path: str, fields: Mapping[str, Column], checkpoint: str):
    """A writer that keeps the stored index at `path` up with a stream of items (item and what `fields` read); start it by `.start()`.

    Each batch is merged by content hash under the checkpoint's name and the batch's
    number: one that is replayed, after a restart or by a new checkpoint over the same
    files, changes nothing.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def take(batch: DataFrame, number: int) -> None:
        index.merge(batch, path, fields, (name, number))

    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
