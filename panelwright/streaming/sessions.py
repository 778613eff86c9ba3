"""Sessions: windows that grow while events of a key follow one another within a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.streaming.runs import dropped_rows


def sessions(events: DataFrame, key: str, ts: str, value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(sample_id, start, last, n, total, least, greatest) of each session of a stream or table.

    Two events belong together if the second comes less than ``gap`` after the first. In a stream a late event may join
    two sessions until the watermark, ``late`` behind the latest event, has passed them; later rows are left out and counted.
    """
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    v = F.col(value)
    w = F.session_window(ts, gap)
    found = marked.groupBy(F.col(key).alias("sample_id"), w.alias("w")).agg(F.max(ts).alias("last"), F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest"))
    return found.select("sample_id", F.col("w.start").alias("start"), "last", "n", "total", "least", "greatest")


def run_sessions(stream: DataFrame, folder: str, **settings) -> tuple[DataFrame, int]:
    """(sessions that are over, number of late rows left out) of what a stream has; sessions not passed by the watermark wait for more."""
    made = sessions(stream, **settings)
    query = made.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(made.schema).parquet(f"{folder}/out"), dropped_rows(query)
