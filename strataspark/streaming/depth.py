"""Streams of depth readings: event-time bins and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_bins(readings: DataFrame, at: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of each bin; works on a stream (with a watermark) and on a table."""
    df = readings.withColumn(at, F.col(at).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(at, late)
    out = df.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bin_start"), "n", "total")


def sessions(readings: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of readings without a gap; the end is the last reading plus the gap."""
    df = readings.withColumn(at, F.col(at).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(at, gap)
    out = df.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")
