"""Tumbling, sliding and session windows of events, the same code for a batch and for a stream.

``ts`` without a time zone is read as UTC. On a stream, late events are dropped by the watermark; on a batch it has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): events and their summed value in cents for each window and type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of a user's events with gaps under ``gap``; the end is the last event plus the gap."""
    got = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def first_of(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their keys inside the watermark (on a batch: without repeats)."""
    t = timed(events, late)
    return t.dropDuplicatesWithinWatermark(keys) if t.isStreaming else t.dropDuplicates(keys)
