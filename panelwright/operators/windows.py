"""Sliding windows, forecast windows, patches and holdouts over positions of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.arrays import col


def _starts(n: Column, need: int, stride: int) -> Column:
    return F.when(n >= need, F.sequence(F.lit(0), (n - need).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def sliding_windows(panel: DataFrame, window: int = 50, stride: int = 1, horizon: int = 1, drop_incomplete: bool = True) -> DataFrame:
    """Rows (keys, start, window, target) for each window of each series; too short a series gives none.

    With ``drop_incomplete=False`` the start after the last complete window is used too when its window
    fits: its target is filled up with zeros, or null when nothing is left of the series.
    """
    if window < 1 or stride < 1 or horizon < 0:
        raise ValueError("window and stride must be at least 1, horizon at least 0")
    keys = [c for c in panel.columns if c != "x"]
    x, n = F.col("x"), F.size("x")
    starts = _starts(n, window + horizon, stride)
    if not drop_incomplete:
        last = F.when(n >= window + horizon, (F.floor((n - window - horizon) / stride) + 1) * stride).otherwise(F.lit(0)).cast("int")
        starts = F.when(n >= last + window, F.concat(starts, F.array(last))).otherwise(starts)
    rows = panel.select(*keys, "x", F.explode(starts).alias("start"))
    rest = F.slice(x, F.col("start") + window + 1, F.lit(horizon))
    target = F.when(F.size(rest) == horizon, rest).when(F.size(rest) > 0, F.concat(rest, F.array_repeat(F.lit(0.0), F.lit(horizon) - F.size(rest))))
    return rows.select(*keys, "start", F.slice(x, F.col("start") + 1, F.lit(window)).alias("window"), target.alias("target"))


def forecast_windows(panel: DataFrame, window: int, horizon: int, stride: int | None = None) -> DataFrame:
    """Windows with whole targets; the stride is the horizon unless given."""
    return sliding_windows(panel, window, stride or horizon, horizon)


def patches(panel: DataFrame, length: int, stride: int) -> DataFrame:
    """Rows (keys, patch_id, patch): (n - length) / stride + 1 overlapping pieces of each series."""
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be at least 1")
    keys = [c for c in panel.columns if c != "x"]
    rows = panel.select(*keys, "x", F.posexplode(_starts(F.size("x"), length, stride)).alias("patch_id", "start"))
    return rows.select(*keys, "patch_id", F.slice("x", F.col("start") + 1, F.lit(length)).alias("patch"))


def forecast_holdout(panel: DataFrame, horizon: int) -> DataFrame:
    """``train`` without the last ``horizon`` values and ``test`` with them; a series of that length or less trains whole and its test is NaN."""
    n = F.size("x")
    nan = F.array_repeat(F.lit(float("nan")), F.lit(horizon))
    keys = [c for c in panel.columns if c != "x"]
    return panel.select(
        *keys,
        F.when(n > horizon, F.slice(col("x"), F.lit(1), n - horizon)).otherwise(col("x")).alias("train"),
        F.when(n > horizon, F.slice(col("x"), n - horizon + 1, F.lit(horizon))).otherwise(nan).alias("test"),
    )


def pad_sequences(panel: DataFrame, length: int | None = None, value: float = 0.0, side: str = "post") -> DataFrame:
    """Series of equal length: the longest of all unless given, from one aggregate row."""
    from panelwright.functions.arrays import pad

    n = length if length is not None else (panel.agg(F.max(F.size("x"))).first()[0] or 0)
    return panel.withColumn("x", pad("x", n, value, side))


def truncate_to_shortest(panel: DataFrame) -> DataFrame:
    n = panel.agg(F.min(F.size("x"))).first()[0] or 0
    return panel.withColumn("x", F.slice("x", 1, n))
