"""Structured Streaming over tick tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(ticks: DataFrame, late: str = "1 hour", scale: str = "4 hours", stride: str = "2 hours") -> DataFrame:
    """ticks: (ts, label, score). Sliding window counts and scores with a watermark for late ticks; also runs on batches."""
    marked = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    return marked.groupBy(F.window("ts", scale, stride), "label").agg(F.count("*").alias("ticks"), F.max("score").alias("score")).select(F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), "label", "ticks", "score")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    marked = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    return marked.groupBy(F.session_window("ts", gap), "label").agg(F.count("*").alias("ticks")).select(F.col("session_window.start").alias("t0"), F.col("session_window.end").alias("t1"), "label", "ticks")
