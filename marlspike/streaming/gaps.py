"""Sessions over a stream: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_sessions(events: DataFrame, key: str, time: str, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, events) of a stream of moments; a session closes when ``late`` has passed after it.

    Spark's session windows keep one state a key and open session; the end is the last event's time plus the gap.
    """
    marked = events.withWatermark(time, late)
    windows = marked.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("events"))
    return windows.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def streamed_counts(events: DataFrame, time: str, label: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, label, count) in windows of fixed width."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(label)).count()
    return windows.select(F.col("w.start").alias("start"), label, "count")
