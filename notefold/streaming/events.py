"""Event streams: windows, sessions, first-seen filter, last state. Each works on a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def windows(df: DataFrame, ts: str, by: list[str], width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(start, by, n) of tumbling windows; rows later than ``delay`` are dropped on a stream only."""
    return _late(df, ts, delay).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(key, start, end, n): runs of a key's events with pauses shorter than ``gap``; null keys have none."""
    rows = _late(df.where(F.col(key).isNotNull()), ts, delay)
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(df: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """One row of each key, on a stream within the watermark."""
    return _late(df, ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def last_state(df: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """Latest values by key; on a stream write it in update mode."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *value)).alias("s")).select(key, *(F.col(f"s.{v}").alias(v) for v in value))
