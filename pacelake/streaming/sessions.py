"""Streaming variants of the session operators (an extension: the batch operators are the reference point)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key by inactivity; works on a batch and, with a watermark, on a stream."""
    timed = events.withColumn("at_", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at_", late)
    s = timed.groupBy(key, F.session_window("at_", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    timed = events.withColumn("at_", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at_", late)
    w = timed.groupBy(F.window("at_", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
