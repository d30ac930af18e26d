"""Delivery of chunks as they arrive: one micro-batch for each, merged by associative sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import has


def stream_chunks(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """New chunk files of a folder as a stream, a few for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def label_sums(labels: DataFrame, n_concepts: int) -> DataFrame:
    """n and the count of every concept: sums that partial results of any chunks add up to."""
    return labels.agg(F.count("*").alias("n"), *[F.sum(F.when(has(F.col("concepts"), i), 1).otherwise(0)).alias(f"c{i}") for i in range(n_concepts)])


def write_increments(stream: DataFrame, transform, target: str, checkpoint: str, key: str = "chunk_idx"):
    """Each micro-batch's ``transform`` is appended to ``target`` under its batch number.

    A batch that runs again after a failure overwrites its own folder, so nothing counts twice, and readers
    re-aggregate the whole table for totals.
    """

    def batch(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_label_sums(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns if c != "batch"])


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, with a watermark where the input streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
