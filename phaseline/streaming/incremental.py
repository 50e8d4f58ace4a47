"""Incremental 2x2 tables: counts are sums, so a stream keeps them current.

An extension of this engine.  Late rows beyond the watermark are dropped by
Spark's own rule; measures are a projection of the running counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counts import count_columns


def windowed_contingency(stream: DataFrame, ts: str, window: str, watermark: str, keys: list[str]) -> DataFrame:
    """(start, keys, a, b, c, d) of tumbling windows of a stream or a table with ``ar`` and ``ep``."""
    d = stream.withWatermark(ts, watermark)
    g = d.groupBy(F.window(ts, window).alias("w"), *keys).agg(*count_columns())
    return g.select(F.col("w.start").alias("start"), *keys, "a", "b", "c", "d")


def exposure_episodes(stream: DataFrame, ts: str, gap: str, watermark: str, keys: list[str]) -> DataFrame:
    """(start, stop, keys, n): sessions of exposed rows that are at most ``gap`` apart."""
    d = stream.where("ar = 1").withWatermark(ts, watermark)
    g = d.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("s.start").alias("start"), F.col("s.end").alias("stop"), *keys, "n")
