"""Streams of events: daily counts behind a watermark, and a table kept by merges of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import upserted


def event_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream; naive times become instants, which watermarks need (the session's zone is UTC)."""
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Counts and sums of each type and day; a day is final once `late` has passed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "total")


def requests_per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sliding minutes that start each second of ten."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds")).agg(F.count("*").alias("n"))


def merged(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], refresh: list[str], order: list, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the stored table; write() gets the whole new table and the batch's number, so
    a batch that is tried again replaces what it wrote."""

    def merge(batch: DataFrame, number: int) -> None:
        write(upserted(read(), batch, keys, refresh, order), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
