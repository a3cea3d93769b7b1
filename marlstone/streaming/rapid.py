"""Streaming forms of the rapid-movement question; an extension, as the batch queries
need no streams. State is bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rapid_windows(events: DataFrame, key: str = "user_id", at: str = "ts", least: int = 3, length: str = "1 day", slide: str = "1 hour",
                  late: str = "2 hours") -> DataFrame:
    """Sliding windows in which a key has `least` events or more; events that come later
    than the watermark allows are left out. Works on batch frames too."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, length, slide), key).agg(F.count("*").alias("events"))
    return windows.filter(F.col("events") >= least).select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: its events with no gap longer than `gap`, with their number."""
    made = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("events"))
    return made.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
