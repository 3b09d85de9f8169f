"""Profiles kept up to date from a stream of events (an extension; batch results are the reference).

A bin depends on when an item ends, so the stream is given each item's span up front: ``spans``
(item_id, t0, t1 as timestamps) is a static table joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import N_BINS


def binned(events: DataFrame, spans: DataFrame, key: str = "user_id") -> DataFrame:
    """(item_id, bin, ts) of events within their item's span; works on streams and tables alike."""
    rows = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros
    at = F.least(F.lit(N_BINS - 1), F.floor(F.lit(float(N_BINS)) * (us("ts") - us("t0")) / F.greatest(F.lit(1), us("t1") - us("t0")))).cast("int")
    return rows.join(spans, "item_id").filter("ts >= t0 AND ts <= t1").select("item_id", at.alias("bin"), "ts")


def bin_counts(events: DataFrame, spans: DataFrame, key: str = "user_id", late: str = "1 day") -> DataFrame:
    """(item_id, bin, day, n): running counts; events later than ``late`` behind the newest are dropped
    once their day has been closed. State is one counter per item, bin and open day."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return binned(stream, spans, key).groupBy("item_id", "bin", F.window("ts", "1 day").alias("day")).agg(F.count("*").alias("n"))
