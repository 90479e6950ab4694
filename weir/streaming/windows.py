"""Structured Streaming forms: tumbling counts, settled changes of a path, and relay without repeats.

Each works on batch and streaming DataFrames with a timestamp ``ts``; late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "topic").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "topic", "n")


def settled(events: DataFrame, quiet: str = "5 seconds", late: str = "1 hour") -> DataFrame:
    """Changes of a path between which less than ``quiet`` passes, as one."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "file").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
    return g.select(F.col("session_window.start").alias("start"), "file", "n", "last_id")


def relayed(events: DataFrame, me: str, late: str = "1 hour") -> DataFrame:
    """Each event once, without one's own."""
    rows = events.filter(F.col("author") != me)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]) if events.isStreaming else rows.dropDuplicates(["id"])
