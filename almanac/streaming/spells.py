"""Spells over streams: the nearest streaming form of chaining rows with small gaps within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_spells(events: DataFrame, key: str, time: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """key, first, last, n: sessions that end after ``gap`` without a row; works on streams and tables alike.

    Rows later than ``late`` behind the newest are dropped from a stream."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    sessions = source.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return sessions.select(key, "first", "last", "n")
