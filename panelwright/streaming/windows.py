"""Extension: panels from a stream of events by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_features(events: DataFrame, key: str, ts: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation, least and greatest value by key and event-time window; rows later than ``late`` are left out. Works on streams and tables."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    v = F.col(value)
    return marked.groupBy(F.col(key).alias("sample_id"), w.alias("w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).select("sample_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "min", "max")
