"""Tumbling daily bars from a stream of events, appended as days close; equal to the batch bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, late: str = "10 days") -> DataFrame:
    """events (code, ts, value), streaming or not -> (code, dt, open, high, low, close, volume, amount)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = e.groupBy("code", F.window("ts", "1 day").alias("w")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"))
    return w.select("code", F.to_date("w.start").alias("dt"), "open", "high", "low", "close", "volume", "amount")
