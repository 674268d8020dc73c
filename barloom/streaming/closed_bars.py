"""Closed bars from a stream of ticks: a bar is emitted once the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(ticks: DataFrame, step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(symbol, ts, open, high, low, close) of ticks (symbol, at TIMESTAMP, seq, price), for append mode."""
    order = F.struct("at", "seq")
    bars = ticks.withWatermark("at", late).groupBy("symbol", F.window("at", step).alias("w"))
    out = bars.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"))
    return out.select("symbol", F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close")
