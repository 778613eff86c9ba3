"""Scaling and filling of series, by sample in one row or by statistics of all data in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import arrays as A


def _moments(x):
    """(mean, population deviation, or 1 where that is below 1e-8)."""
    m = A.total(x) / F.size(x)

    def both(m):
        std = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x))
        return A.let(std, lambda s: F.struct(m.alias("m"), F.when(s < 1e-8, 1.0).otherwise(s).alias("s")))

    return A.let(m, both)


def standardize_series(panel: DataFrame) -> DataFrame:
    """Each series by its own mean and population deviation; deviations under 1e-8 count as 1."""
    x = F.col("x")
    return panel.withColumn("x", A.let(_moments(x), lambda k: F.transform(x, lambda v: (v - k["m"]) / k["s"])))


def standardize_samples(panel: DataFrame) -> DataFrame:
    """By the mean and deviation over all variables and steps of a sample.

    Each series gives its count, mean and sum of squared deviations; a sample's variables merge theirs, so a large mean costs no digits.
    """
    x = F.col("x")
    mean = A.total(x) / F.size(x)
    own = A.let(mean, lambda m: F.struct(F.size(x).cast("double").alias("n"), m.alias("m"), F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)).alias("q")))

    def merge(a, b):
        n, d = a["n"] + b["n"], b["m"] - a["m"]
        return F.struct(n.alias("n"), (a["m"] + d * b["n"] / n).alias("m"), (a["q"] + b["q"] + d * d * a["n"] * b["n"] / n).alias("q"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
    stats = panel.where(F.size("x") > 0).groupBy("sample_id").agg(F.aggregate(F.collect_list(own), none, merge).alias("_s"))
    std = F.sqrt(F.col("_s.q") / F.col("_s.n"))
    stats = stats.select(F.col("sample_id").alias("_id"), F.col("_s.m").alias("_m"), F.when(std < 1e-8, 1.0).otherwise(std).alias("_d"))
    j = panel.join(stats, panel.sample_id == stats["_id"], "left")
    return j.withColumn("x", F.transform("x", lambda v: (v - F.col("_m")) / F.col("_d"))).drop("_id", "_m", "_d")


class Standardizer:
    """Mean and deviation of training data, applied to any: (x - mean) / (std + 1e-8)."""

    def __init__(self, mean: float, std: float):
        self.mean, self.std = mean, std

    @classmethod
    def fit(cls, panel: DataFrame) -> Standardizer:
        n, m, s = panel.select(F.explode("x").alias("v")).agg(F.count("v"), F.avg("v"), F.stddev_pop("v")).first()
        return cls(m if n else 0.0, s if n else 1.0)

    def transform(self, panel: DataFrame) -> DataFrame:
        return panel.withColumn("x", F.transform("x", lambda v: (v - self.mean) / (self.std + 1e-8)))


def standardize_all(panel: DataFrame) -> DataFrame:
    """By the mean and deviation of all values; deviations under 1e-8 count as 1."""
    s = Standardizer.fit(panel)
    std = 1.0 if s.std < 1e-8 else s.std
    return panel.withColumn("x", F.transform("x", lambda v: (v - s.mean) / std))


def minmax_scale(panel: DataFrame) -> DataFrame:
    x = F.col("x")
    ends = F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"))
    return panel.withColumn("x", A.let(ends, lambda k: F.transform(x, lambda v: (v - k["lo"]) / (k["hi"] - k["lo"] + 1e-8))))


def robust_scale(panel: DataFrame) -> DataFrame:
    """(x - median) / (iqr + 1e-8) with linear percentiles."""
    x = F.col("x")
    stats = A.let(F.array_sort(x), lambda o: F.struct(A.median(o).alias("m"), (A.quantile_linear(o, 0.75) - A.quantile_linear(o, 0.25)).alias("q")))
    return panel.withColumn("x", A.let(stats, lambda k: F.transform(x, lambda v: (v - k["m"]) / (k["q"] + 1e-8))))


def fill_missing(panel: DataFrame, how: str = "mean") -> DataFrame:
    """NaN and null become the mean of the series' other values (0 without any), or 0."""
    x = F.col("x")
    bad = lambda v: v.isNull() | F.isnan(v)
    if how == "zero":
        return panel.withColumn("x", F.transform(x, lambda v: F.when(bad(v), 0.0).otherwise(v)))
    mean = A.let(F.filter(x, lambda v: ~bad(v)), lambda ok: F.when(F.size(ok) > 0, A.total(ok) / F.size(ok)).otherwise(0.0))
    return panel.withColumn("x", A.let(mean, lambda m: F.transform(x, lambda v: F.when(bad(v), m).otherwise(v))))
