"""Label mixing: each sample blends with a partner of a shuffled order.

The shuffle is a ring: rows are ranked by a hashed draw, in a class or in all data, and each row's partner
is the next. Ranks come from splits.global_rank and class_rank, so no task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import rand as R
from panelwright.operators.splits import class_rank, global_rank


def mix_lambda(seed: int, op: str, alpha: float) -> Column:
    """u^(1/a) / (u^(1/a) + v^(1/a)), once for all rows."""
    u, v = F.pow(R.uniform(seed, op + "/u"), F.lit(1 / alpha)), F.pow(R.uniform(seed, op + "/v"), F.lit(1 / alpha))
    return u / (u + v)


def partners(samples: DataFrame, seed: int, op: str, label: str | None = None) -> DataFrame:
    """(sample_id, partner): the next sample in the shuffled ring, of the same ``label`` if given. ``samples`` has a row a sample."""
    keys = ["sample_id"] + ([label] if label else [])
    rows = samples.select(*keys)
    ranked = class_rank(rows, seed, "sample_id", label, op).withColumnRenamed("class_rank", "rank") if label else global_rank(rows, R.bits(seed, op, "sample_id"), "sample_id")
    sizes = ranked.groupBy(*([label] if label else [])).agg(F.count(F.lit(1)).alias("_n"))
    a = ranked.join(sizes, label) if label else ranked.crossJoin(F.broadcast(sizes))  # one row a class, or one
    nxt = a.withColumn("_next", (F.col("rank") + 1) % F.col("_n"))
    b = ranked.select(F.col("sample_id").alias("partner"), F.col("rank").alias("_k"), *([F.col(label).alias("_l")] if label else []))
    on = (nxt["_next"] == b["_k"]) & (nxt[label] == b["_l"] if label else F.lit(True))
    return nxt.join(b, on).select("sample_id", "partner")


def _paired(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    other = panel.select(F.col("sample_id").alias("partner"), F.col("var_id").alias("_v"), F.col("x").alias("_x"))
    a = panel.join(pairs, "sample_id")
    return a.join(other, (a["partner"] == other["partner"]) & (a["var_id"] == other["_v"])).drop(other["partner"]).drop("_v")


def mixup(panel: DataFrame, samples: DataFrame, alpha: float = 0.4, seed: int = 42) -> DataFrame:
    """x becomes l x + (1 - l) partner; ``lam`` and ``partner`` tell how to blend the labels."""
    lam = mix_lambda(seed, "mixup", alpha)
    p = _paired(panel, partners(samples, seed, "mixup"))
    return p.withColumn("lam", lam).withColumn("x", F.zip_with("x", "_x", lambda a, b: lam * a + (1 - lam) * b)).drop("_x")


def cutmix(panel: DataFrame, samples: DataFrame, alpha: float = 1.0, seed: int = 42, label: str | None = None) -> DataFrame:
    """One region of clamp(round((1 - l) L), 1, L - 1) steps is the partner's; ``lam`` is the share kept. With ``label`` partners are of the same class."""
    op = "intra_cutmix" if label else "cutmix"
    n = F.size("x")
    cut = F.greatest(F.least(F.round((1 - mix_lambda(seed, op, alpha)) * n), n - 1), F.lit(1)).cast("int")
    start = (R.uniform(seed, op + "/start") * (n - cut + 1)).cast("int")
    p = _paired(panel, partners(samples, seed, op, label))
    mixed = F.transform(F.zip_with("x", "_x", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z, t: F.when((t >= start) & (t < start + cut), z["b"]).otherwise(z["a"]))
    return p.withColumn("lam", 1 - cut / n).withColumn("x", mixed).drop("_x")


def mix_labels(df: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """Adds ``y``: lam times the one-hot label plus the rest of the partner's."""
    from panelwright.schema import one_hot

    mine = labels.select(F.col("sample_id").alias("_a"), one_hot("label", n_classes).alias("_ya"))
    other = labels.select(F.col("sample_id").alias("_b"), one_hot("label", n_classes).alias("_yb"))
    j = df.join(mine, df["sample_id"] == F.col("_a")).join(other, F.col("partner") == F.col("_b"))
    return j.withColumn("y", F.zip_with("_ya", "_yb", lambda a, b: F.col("lam") * a + (1 - F.col("lam")) * b)).drop("_a", "_b", "_ya", "_yb")


STRATEGIES = {"mixup": mixup, "cutmix": cutmix, "intra_class": lambda panel, samples, alpha, seed: cutmix(panel, samples, alpha, seed, label="label")}


def mix(panel: DataFrame, samples: DataFrame, strategy: str = "mixup", alpha: float = 0.4, seed: int = 42) -> DataFrame:
    """Mixing by a named strategy; ``random`` draws one of them from the seed."""
    if strategy == "random":
        import hashlib

        strategy = sorted(STRATEGIES)[int(hashlib.md5(f"{seed}:mix".encode()).hexdigest()[:8], 16) % len(STRATEGIES)]
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    return STRATEGIES[strategy](panel, samples, alpha=alpha, seed=seed)
