"""Timelines over streams: the batch definitions with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_ranges(stream: DataFrame, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, messages, first, last) so far; for output mode complete or update."""
    return stream.groupBy(key).agg(F.count("*").alias("messages"), F.min(time).alias("first"), F.max(time).alias("last"))


def windowed_counts(stream: DataFrame, key: str = "event_type", time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Messages per window and key; rows later than the watermark are dropped, windows are final in append mode."""
    x = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("messages"))
    return x.select(F.col("window.start").alias("start"), key, "messages")
