"""How the test tables become panels, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Univariate panel of 64 steps with its label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.lit(0).alias("var_id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in order of time: (sample_id, t, value)."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("sample_id"), t.alias("t"), "value")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged univariate panel: one series a user, gathered without a window."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    cells = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return e.groupBy(F.col("user_id").alias("sample_id")).agg(F.transform(cells, lambda c: c["value"]).alias("x")).select("sample_id", F.lit(0).alias("var_id"), "x")


def quarters(spark: SparkSession, sf_dir: str, n_vars: int = 4, length: int = 16) -> DataFrame:
    """Multivariate panel: each vector cut into ``n_vars`` series."""
    v = vectors(spark, sf_dir)
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_vars - 1)), lambda i: F.struct(i.alias("var_id"), F.slice(F.col("x"), i * length + 1, F.lit(length)).alias("x")))
    return v.select("sample_id", "label", F.explode(cut).alias("s")).select("sample_id", "s.var_id", "label", "s.x")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, logits): the first ten values stand for class scores."""
    return vectors(spark, sf_dir).select("sample_id", "label", F.slice("x", 1, 10).alias("logits"))


#: Added before rounding, so that exact halves don't hang on the order of a sum.
OFF = 1.37e-7


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(OFF), digits) + F.lit(0.0)


# SQL of the same: common table expressions to be put after WITH
E = "e AS (SELECT vec_id AS sample_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INT AS t FROM embeddings)"
V = "x AS (SELECT vec_id AS sample_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings)"
S = "e AS (SELECT user_id AS sample_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, value AS v FROM events)"
Q = "q AS (SELECT sample_id, label, (t // 16)::INT AS var_id, (t % 16)::INT AS t, v FROM e)"
L = "l AS (SELECT sample_id, label, t AS c, v AS z FROM e WHERE t < 10)"
P = L + ", p AS (SELECT sample_id, label, c, exp(z - max(z) OVER (PARTITION BY sample_id)) / sum(exp(z - m)) OVER (PARTITION BY sample_id) AS p FROM (SELECT *, max(z) OVER (PARTITION BY sample_id) AS m FROM l))"
K = P + ", k AS (SELECT sample_id, label, c AS pred, p AS conf FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, c DESC) AS rn FROM p) WHERE rn = 1)"


def rr(c: str, digits: int = 6) -> str:
    return f"(round(({c}) + {OFF}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def rounded(cols: str, digits: int = 6) -> str:
    return ", ".join(f"{rr(c, digits)} AS {c}" for c in cols.split())
