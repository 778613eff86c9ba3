"""Losses as expressions of one row; ``avg`` over rows gives the batch value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import arrays as A


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_softmax(logits: Column | str) -> Column:
    lse = lambda z: A.let(F.array_max(z), lambda top: F.log(F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top)
    return A.let(_c(logits), lambda z: A.let(lse(z), lambda s: F.transform(z, lambda v: v - s)))


def cross_entropy(logits, label) -> Column:
    return -F.get(log_softmax(logits), _c(label).cast("int"))


def focal(logits, label, gamma: float = 2.0, alpha: float | list[float] = 1.0) -> Column:
    p = F.greatest(F.get(A.softmax(logits), _c(label).cast("int")), F.lit(1e-8))
    a = F.get(F.array(*[F.lit(float(v)) for v in alpha]), _c(label).cast("int")) if isinstance(alpha, list) else F.lit(float(alpha))
    return -a * F.pow(1 - p, F.lit(gamma)) * F.log(p)


def label_smoothing(logits, label, smoothing: float = 0.1) -> Column:
    ls = log_softmax(logits)
    others = smoothing / F.greatest(F.size(_c(logits)) - 1, F.lit(1))
    return -F.aggregate(F.transform(ls, lambda v, i: v * F.when(i == _c(label), 1 - smoothing).otherwise(others)), F.lit(0.0), lambda a, v: a + v)


def squared(pred, target) -> Column:
    d = _c(pred) - _c(target)
    return d * d


def huber(pred, target, delta: float = 1.0) -> Column:
    d = F.abs(_c(pred) - _c(target))
    return F.when(d <= delta, 0.5 * d * d).otherwise(delta * d - 0.5 * delta * delta)


def log_cosh(pred, target) -> Column:
    d = F.abs(_c(pred) - _c(target))
    return d + F.log1p(F.exp(-2 * d)) - 0.6931471805599453


def tweedie(pred, target, power: float = 1.5) -> Column:
    """``pred`` is the logarithm of the mean; negative targets count as 0."""
    mu = F.greatest(F.exp(_c(pred)), F.lit(1e-8))
    y = F.greatest(_c(target), F.lit(0.0))
    return -y * F.pow(mu, F.lit(1 - power)) / (1 - power) + F.pow(mu, F.lit(2 - power)) / (2 - power)


def tweedie_deviance(pred, target, power: float = 1.5) -> Column:
    mu = F.greatest(F.exp(_c(pred)), F.lit(1e-8))
    y = F.greatest(_c(target), F.lit(0.0))
    return 2 * (F.pow(y, F.lit(2 - power)) / ((1 - power) * (2 - power)) - y * F.pow(mu, F.lit(1 - power)) / (1 - power) + F.pow(mu, F.lit(2 - power)) / (2 - power))


def masked_mean(loss: Column, pred, target) -> Column:
    """Mean over pairs without NaN or null, 0 when there is none."""
    ok = ~(F.isnan(_c(pred)) | F.isnan(_c(target)) | _c(pred).isNull() | _c(target).isNull())
    return F.coalesce(F.avg(F.when(ok, loss)), F.lit(0.0))


def center_loss(df: DataFrame, centers: DataFrame, features: str = "x", label: str = "label") -> DataFrame:
    """Adds ``center_loss``: half the squared distance to the centre of the row's class; classes without one count as centred at zero. ``centers``: (label, center), a row a class."""
    c = centers.select(F.col("label").alias("_l"), F.col("center").alias("_c"))
    j = df.join(c, df[label] == F.col("_l"), "left")
    zero = F.transform(features, lambda v: v * 0)
    d = F.zip_with(features, F.coalesce("_c", zero), lambda a, b: (a - b) * (a - b))
    return j.withColumn("center_loss", 0.5 * A.total(d)).drop("_l", "_c")


def updated_centers(df: DataFrame, centers: DataFrame, alpha: float = 0.5, features: str = "x", label: str = "label") -> DataFrame:
    """Centres moved by alpha times the mean difference of their rows: (label, center)."""
    means = df.select(F.col(label).alias("label"), F.posexplode(features).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    old = centers.select("label", F.posexplode("center").alias("i", "c"))
    new = means.join(old, ["label", "i"], "full").select("label", "i", F.when(F.col("m").isNull(), F.col("c")).otherwise(F.coalesce("c", F.lit(0.0)) + alpha * (F.col("m") - F.coalesce("c", F.lit(0.0)))).alias("v"))
    return new.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("center"))


def center_plus(df: DataFrame, centers: DataFrame, logits: str = "logits", lam: float = 0.003, features: str = "x", label: str = "label") -> DataFrame:
    """Adds ``loss``: cross entropy plus ``lam`` times the center loss."""
    j = center_loss(df, centers, features, label)
    return j.withColumn("loss", cross_entropy(logits, label) + lam * F.col("center_loss")).drop("center_loss")
