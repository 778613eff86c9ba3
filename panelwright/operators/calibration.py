"""Reliability bins, calibration errors and temperature scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import arrays as A


def from_logits(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds probs, prob (the largest) and pred (its place, the last of ties)."""
    p = df.withColumn("probs", A.softmax("logits", temperature))
    return p.withColumn("prob", F.array_max("probs")).withColumn("pred", A.argmax_last("probs"))


def _bin(n_bins: int):
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob")))
    return F.least(F.floor(conf * n_bins), F.lit(n_bins - 1)).cast("int")


def bins(preds: DataFrame, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(bin, n, confidence, accuracy) of non-empty bins."""
    by = by or []
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob")))
    right = (F.col("pred") == F.col("label")).cast("double")
    return preds.groupBy(*by, _bin(n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(right).alias("accuracy"))


def all_bins(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """As bins, with empty bins at their midpoint for both values, so that their gap is 0."""
    every = preds.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    mid = (F.col("bin") + 0.5) / n_bins
    return every.join(F.broadcast(bins(preds, n_bins)), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", mid).alias("confidence"), F.coalesce("accuracy", mid).alias("accuracy"))


def errors(preds: DataFrame, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """ece (gap weighted by count) and mce (largest gap), for each group of ``by``."""
    by = by or []
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    b = bins(preds, n_bins, by)
    return (b.groupBy(*by) if by else b).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def leaning_bins(preds: DataFrame, n_bins: int = 10, least: float = 0.01) -> DataFrame:
    """Bins whose confidence is above (over) or below (under) their accuracy by more than ``least``."""
    gap = F.col("confidence") - F.col("accuracy")
    return bins(preds, n_bins).withColumn("kind", F.when(gap > least, "over").when(gap < -least, "under")).where("kind IS NOT NULL")


def optimal_temperature(df: DataFrame, lo: float = 0.5, hi: float = 5.0, steps: int = 20, n_bins: int = 10) -> DataFrame:
    """One row (temperature, ece): the grid point of smallest ECE, the first of ties. Every row is scored at each of the grid's points in one pass."""
    grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
    each = df.select("label", "logits", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("step", "temperature"))
    p = each.withColumn("probs", A.softmax("logits", F.col("temperature")))
    scored = p.select("step", "temperature", "label", F.array_max("probs").alias("prob"), A.argmax_last("probs").alias("pred"))
    e = errors(scored, n_bins, ["step", "temperature"])
    return e.agg(F.min_by("temperature", F.struct("ece", "step")).alias("temperature"), F.min("ece").alias("ece"))


def is_well_calibrated(preds: DataFrame, limit: float = 0.05, n_bins: int = 10) -> DataFrame:
    """One row: ece, mce, and whether the ece is below ``limit``."""
    return errors(preds, n_bins).withColumn("well_calibrated", F.col("ece") < limit)
