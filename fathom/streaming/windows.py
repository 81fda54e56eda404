"""Windowed aggregation of event streams with late data (an extension: the batch queries give the same rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: Column, *keys: str, lateness: str = "1 hour") -> DataFrame:
    """Counts and sums of value by window and keys; events later than `lateness` behind the newest are dropped."""
    grouped = events.withWatermark("ts", lateness).groupBy(window.alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), *keys, "n", "total")


def tumbling(events: DataFrame, length: str = "1 hour", *keys: str) -> DataFrame:
    return windowed(events, F.window("ts", length), *keys)


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", *keys: str) -> DataFrame:
    return windowed(events, F.window("ts", length, step), *keys)


def sessions(events: DataFrame, gap: str = "30 minutes", *keys: str) -> DataFrame:
    return windowed(events, F.session_window("ts", gap), *keys)


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Starts the stream into an in-memory table, all available input at once; state lives in `checkpoint`."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
