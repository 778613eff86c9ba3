"""Readers of series files. Text formats are parsed by Spark's text source and array expressions; NumPy files by task."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.sources.npy import PARTITION_BYTES, NpySource

from panelwright import schema

NAN = float("nan")


def read_csv(spark: SparkSession, path: str, n_vars: int, seq_len: int, has_labels: bool = False, id_col: str | None = None) -> DataFrame:
    """Panel of a headed file whose columns are var 0 step 0, var 0 step 1, ... and perhaps a label last; unreadable cells are 0."""
    df = spark.read.csv(path, header=True)
    cells = [c for c in df.columns if c != id_col]
    want = n_vars * seq_len + has_labels
    if len(cells) != want:
        raise ValueError(f"{len(cells)} columns, {want} expected")
    rows = df.withColumn("sample_id", F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id())
    if not has_labels:
        return schema.wide_to_panel(rows, "sample_id", cells, n_vars)
    rows = rows.withColumn("label", F.expr(f"try_cast(`{cells[-1]}` AS DOUBLE)"))
    return schema.wide_to_panel(rows, "sample_id", cells[:-1], n_vars, keep=["label"])


def read_parquet(spark: SparkSession, path: str, columns: list[str], n_vars: int, label: str | None = None, sample_id: str | None = None) -> DataFrame:
    """Panel of named columns; only these are read. Nulls are 0."""
    df = spark.read.parquet(path).select(*([sample_id] if sample_id else []), *columns, *([label] if label else []))
    rows = df.withColumn("sample_id", F.col(sample_id).cast("long") if sample_id else F.monotonically_increasing_id())
    length = len(columns) // n_vars
    if n_vars < 1 or length * n_vars != len(columns):
        raise ValueError(f"{len(columns)} columns don't make {n_vars} variables")
    series = F.array(*[F.struct(F.lit(v).alias("var_id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns[v * length : (v + 1) * length]]).alias("x")) for v in range(n_vars)])
    extra = [F.col(label).alias("label")] if label else []
    return rows.select("sample_id", *extra, F.explode(series).alias("s")).select("sample_id", "s.var_id", *(["label"] if label else []), "s.x")


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(NAN))


def _values(text: Column) -> Column:
    """Numbers of a comma list; ``?``, empty and other tokens are NaN."""
    return F.transform(F.split(text, ","), lambda v: _number(F.trim(v)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) without blank lines; pos keeps the order of a file's lines within its splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("line")).where("line <> ''")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Univariate series of lines ``label v0 v1 ...`` parted by tabs or spaces: (sample_id, var_id, label DOUBLE, x)."""
    parts = _lines(spark, path).select("pos", F.split("line", "[\\t ]+").alias("p")).where(F.size("p") > 1)
    label = F.get("p", F.lit(0)).try_cast("double")
    return parts.select(F.col("pos").alias("sample_id"), F.lit(0).alias("var_id"), label.alias("label"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), _number).alias("x"))


def remap_labels(train: DataFrame, test: DataFrame | None = None, label: str = "label") -> tuple[DataFrame, DataFrame | None]:
    """``code`` 0, 1, ... of the sorted distinct labels of train and test together, so that both use the same codes."""
    labels = train.select(label) if test is None else train.select(label).union(test.select(label))
    codes = labels.where(F.col(label).isNotNull()).distinct().select(F.col(label).alias("_l"), (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias("code"))
    join = lambda df: df.join(codes, df[label] == codes["_l"], "left").drop("_l")  # noqa: E731  a row a class
    return join(train), None if test is None else join(test)


def read_ts(spark: SparkSession, path: str, target: str = "class") -> DataFrame:
    """Lines ``a,b,c:d,e,f:label`` after ``@data``: (sample_id, var_id, label STRING or target DOUBLE, x). Shorter dimensions are filled with their last value for classes, NaN for regression."""
    rows = _lines(spark, path).where(~F.col("line").startswith("#") & ~F.col("line").startswith("@"))
    parts = rows.select(F.col("pos").alias("sample_id"), F.split("line", ":").alias("p")).where(F.size("p") > 1)
    last = F.trim(F.element_at("p", -1))
    named = last.alias("label") if target == "class" else _number(last).alias("target")
    dims = parts.select("sample_id", named, F.posexplode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("var_id", "text"))
    series = dims.select("sample_id", "var_id", "label" if target == "class" else "target", _values(F.col("text")).alias("x"))
    longest = series.agg(F.max(F.size("x"))).first()[0] or 0
    fill = F.element_at("x", -1) if target == "class" else F.lit(NAN)
    return series.withColumn("x", F.concat("x", F.array_repeat(fill, F.lit(longest) - F.size("x"))))


def read_tsf(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id|start:v1,v2,?`` after ``@data``: (series_id, start, x); the split is at the first colon after the id and start. Attributes come from tsf_attributes."""
    rows = _lines(spark, path).where(~F.col("line").startswith("#") & ~F.col("line").startswith("@"))
    head, tail = F.regexp_extract("line", "^([^:]*):(.*)$", 1), F.regexp_extract("line", "^([^:]*):(.*)$", 2)
    names = F.split(head, "\\|")
    return rows.select(F.trim(F.get(names, F.lit(0))).alias("series_id"), F.trim(F.get(names, F.lit(1))).alias("start"), _values(tail).alias("x"))


def tsf_attributes(spark: SparkSession, path: str) -> dict[str, str]:
    """Header attributes by lower-case name; a header is a few lines."""
    rows = _lines(spark, path).where(F.col("line").startswith("@")).select(F.split("line", "\\s+", 2).alias("p")).collect()
    return {r.p[0][1:].lower(): (r.p[1] if len(r.p) > 1 else "") for r in rows}


#: Names of a frequency and the horizon that goes with it.
FREQUENCIES = {"second": ("S", 60), "minute": ("T", 60), "hour": ("H", 48), "day": ("D", 30), "week": ("W", 8), "month": ("M", 12), "quarter": ("Q", 4), "year": ("Y", 4)}
DEFAULT_HORIZON = 10


def default_horizon(frequency: Column) -> Column:
    out = F.lit(DEFAULT_HORIZON)
    for word, (letter, horizon) in FREQUENCIES.items():
        names = [letter.lower(), word, word + "s", word + "ly", {"day": "daily", "minute": "minutely"}.get(word, word)] + (["a", "annual"] if word == "year" else []) + (["min"] if word == "minute" else [])
        out = F.when(F.lower(frequency).isin(names), horizon).otherwise(out)
    return out


def read_npy(spark: SparkSession, path: str, key: str | None = None, partition_bytes: int | None = None) -> DataFrame:
    """Panel of the .npy files at ``path`` (a file or a folder), or of the member ``key`` of .npz files, read in ranges of rows; see ``sources.npy``."""
    spark.dataSource.register(NpySource)
    options = {"parts": spark.sparkContext.defaultParallelism, "partitionBytes": partition_bytes or PARTITION_BYTES} | ({"key": key} if key else {})
    return spark.read.format(NpySource.name()).options(**options).load(path)


def read_archive(spark: SparkSession, train: str, test: str, reader=read_tsv) -> DataFrame:
    """Both files of a data set with ``split``. Ids count anew in each file, so training samples get even ids and test samples odd ones."""
    name = lambda path, k, split: reader(spark, path).withColumn("sample_id", F.col("sample_id") * 2 + k).withColumn("split", F.lit(split))
    return name(train, 0, "train").unionByName(name(test, 1, "test"))
