"""Running a stream over what is there, with results that a restarted run doesn't repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hand all available micro-batches to ``each`` (rows, batch id) and end. A batch may come again after a crash, under the same id."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    query.awaitTermination()
    return query


def latest(updates: DataFrame, key: str, folder: str) -> DataFrame:
    """The last row that a stream of updates has for each key. Each micro-batch is a folder of its own, written anew if it comes again."""
    spark = updates.sparkSession
    run_batches(updates, lambda rows, i: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"), f"{folder}/checkpoint")
    rows = spark.read.option("basePath", f"{folder}/out").schema(updates.schema.add("batch", "long")).parquet(f"{folder}/out")
    last = F.max_by(F.struct(*[c for c in updates.columns if c != key]), "batch").alias("_last")
    return rows.groupBy(key).agg(last).select(key, "_last.*")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out, over the batches that the query still knows."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


class VersionedState:
    """A small table that each micro-batch carries further: version i is made from version i - 1 and batch i.

    A batch that comes again after a crash starts from the same version and overwrites its own, so each batch counts once.
    Versions stay in ``path`` until that is cleaned.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def version(self, i: int) -> DataFrame:
        """Version ``i``; before the first batch an empty table."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={i}") if i >= 0 else self.spark.createDataFrame([], self.schema)

    def apply(self, update: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``run_batches``: ``update`` gives the new state from (rows, old state)."""

        def each(rows: DataFrame, i: int) -> None:
            update(rows, self.version(i - 1)).write.mode("overwrite").parquet(f"{self.path}/version={i}")

        return each

    def last(self, query: StreamingQuery | None = None) -> DataFrame:
        """The newest version that is whole."""
        versions = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/version=*").agg(F.max("version")).first()[0]
        return self.version(-1 if versions is None else int(versions))


def averaged(rows: DataFrame, old: DataFrame, key: str, value: str, alpha: float = 0.5) -> DataFrame:
    """Exponential averages by key: (key, average), moved by ``alpha`` towards the batch's mean; a new key starts at its mean, an absent one stays."""
    means = rows.groupBy(key).agg(F.avg(value).alias("_m"))
    moved = F.col("average") + alpha * (F.col("_m") - F.col("average"))
    return means.join(old, key, "full").select(key, F.coalesce(moved, "_m", "average").alias("average"))
