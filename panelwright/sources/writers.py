"""Sinks of panels and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.sources.npy import array_bytes, open_path

from panelwright import schema


def write_time_csv(panel: DataFrame, path: str, n_vars: int) -> None:
    """Files of ``sample_id, time, var0, var1, ...``; the variables are a fixed list, so no pivot looks for them."""
    long = schema.to_long(panel)
    wide = long.groupBy("sample_id", F.col("t").alias("time")).agg(*[F.max(F.when(F.col("var_id") == v, F.col("value"))).alias(f"var{v}") for v in range(n_vars)])
    wide.write.mode("error").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def write_panel(panel: DataFrame, path: str, buckets: int | None = None) -> None:
    """Parquet, hashed by sample where ``buckets`` is given, so that all variables of a sample lie together."""
    (panel.repartition(buckets, "sample_id") if buckets else panel).write.mode("error").parquet(path)


def write_npy(panel: DataFrame, path: str, key: str | None = None) -> str:
    """Rank-3 arrays (sample, variable, step), a .npy file (.npz with ``key``) a partition of whole samples; series must have one length. Returns ``path``."""
    import uuid

    import numpy as np
    import pandas as pd

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            for j, (_, whole) in enumerate(b.groupby(b["xs"].map(len))):
                a = np.stack([np.stack(list(xs)) for xs in whole["xs"]])
                yield pd.DataFrame({"name": [f"part-{part:05d}-{i:05d}-{j}"], "content": [array_bytes(a, key)]})

    series = F.transform(F.array_sort(F.collect_list(F.struct("var_id", "x"))), lambda s: s["x"])
    whole = panel.groupBy("sample_id").agg(series.alias("xs"))
    files = whole.select("xs").mapInPandas(run, "name string, content binary")
    end = "npz" if key else "npy"

    def save(rows):
        for r in rows:
            store, folder = open_path(path)
            store.create_dir(folder, recursive=True)
            half = f"{folder}/_{r.name}.{uuid.uuid4().hex}"  # a task that is tried again leaves no half-written array
            with store.open_output_stream(half, compression=None) as f:
                f.write(r.content)
            store.move(half, f"{folder}/{r.name}.{end}")

    files.foreachPartition(save)
    return path
