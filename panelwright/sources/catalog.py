"""What data sets a folder holds, by the names of their files; the files themselves are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings and the readers of ``sources.readers`` that they are for.
FORMATS = {"tsv": "read_tsv", "ts": "read_ts", "tsf": "read_tsf", "csv": "read_csv", "parquet": "read_parquet", "npy": "read_npy", "npz": "read_npy"}


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(name, format, reader, split, files, bytes): a row a data set and split under ``folder``.

    ``name_TRAIN.ts`` and ``name_TEST.ts``, in a folder of their own or not, are the splits of one data set; a file or folder without such an
    end has split null. Folders written by Spark count as one file set. Hidden files are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    base = folder.removeprefix("file://").rstrip("/")
    inside = F.substring_index(F.col("path"), base + "/", -1)
    parts = F.filter(F.split(inside, "/"), lambda p: ~p.rlike("^part-"))  # files of Spark's writers stand for their folder
    own = F.element_at(parts, -1)
    kind = F.lower(F.regexp_extract(own, r"\.([A-Za-z]+)$", 1))
    stem = F.regexp_replace(own, r"\.[A-Za-z]+$", "")
    split = F.upper(F.regexp_extract(stem, "(?i)_(train|test|valid)$", 1))
    rows = listed.where(~inside.rlike(r"(^|/)[._]")).select(
        F.regexp_replace(stem, "(?i)_(train|test|valid)$", "").alias("name"), kind.alias("format"), F.when(split != "", F.lower(split)).alias("split"), "length"
    )
    reader = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    known = rows.where(F.col("format").isin(*FORMATS))
    return known.groupBy("name", "format", "split").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).select("name", "format", reader[F.col("format")].alias("reader"), "split", "files", "bytes")
