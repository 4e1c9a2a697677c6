"""Windows over event streams: an extension, as the model has no streams of its own.

The functions take a batch or a stream; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each hour and type."""
    w = F.window("ts", "1 hour")
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once; on a stream within the watermark."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
