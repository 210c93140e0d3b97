"""Trailing debounce of change events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str = "key", time: str = "ts", quiet: str = "30 seconds") -> DataFrame:
    """One row per burst: key, first event, last event, changes.

    A burst ends when no event has come for ``quiet``.  On a stream the rows
    come once the watermark passes the end of the burst.
    """
    bursts = events.groupBy(F.col(key).alias("key"), F.session_window(F.col(time), quiet).alias("w"))
    return bursts.agg(F.min(time).alias("first_change"), F.max(time).alias("last_change"), F.count(F.lit(1)).alias("changes")).drop("w")


def watch(events: DataFrame, key: str = "key", time: str = "ts", quiet: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """`debounced` over a streaming DataFrame."""
    return debounced(events.withWatermark(time, late), key, time, quiet)
