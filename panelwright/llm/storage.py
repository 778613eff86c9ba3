"""The shared folder: where jobs keep tables and files that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelwright-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later steps neither recompute it nor depend on executors that held it."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder, for binary files written by tasks."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when complete, so that a retried task leaves no half-written one.

    For use with ``with``: the file is begun by the first write, moved into place at the end, and deleted on an error.
    """

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.out = folder, name, None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.fs, path = open_store(self.folder)
            self.fs.create_dir(path, recursive=True)
            self.final, self.temp = f"{path}/{self.name}", f"{path}/_{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(data)

    def tell(self) -> int:
        return self.out.tell() if self.out else 0

    def __enter__(self) -> AtomicFile:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self.out is None:
            return
        self.out.close()
        if kind is None:
            self.fs.move(self.temp, self.final)
        else:
            self.fs.delete_file(self.temp)


def a_file_a_task(files: DataFrame, *more: str) -> DataFrame:
    """The rows of ``files`` (path and ``more``; a row a file written, so few), in order, each in a partition of its own."""
    rows = sorted(tuple(r) for r in files.select("path", *more).distinct().collect())
    spark, n = files.sparkSession, max(1, len(rows))
    named = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], StructType([StructField("file", LongType()), *files.select("path", *more).schema]))
    return spark.range(0, n, 1, n).withColumnRenamed("id", "file").join(F.broadcast(named), "file").select("path", *more)
