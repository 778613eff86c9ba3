"""Prediction dynamics over epochs, sample weights and pseudo-labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.ranges import before, cuts, in_ranges
from panelwright.operators.splits import rank_by_id


def per_sample(history: DataFrame) -> DataFrame:
    """One row a sample of (sample_id, epoch, pred, true_label, confidence): flips, stability, first and last epochs, regression, difficulty."""
    w = Window.partitionBy("sample_id").orderBy("epoch")
    right = F.col("pred") == F.col("true_label")
    h = history.withColumn("_right", right).withColumn("_k", F.row_number().over(w) - 1).withColumn("_flip", (F.lag("pred").over(w) != F.col("pred")).cast("int"))
    h = h.withColumn("_was", F.max(F.col("_right").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    n = F.count(F.lit(1))
    flips = F.coalesce(F.sum("_flip"), F.lit(0))
    s = h.groupBy("sample_id").agg(
        n.alias("epochs"), F.max("_right").alias("ever_correct"), F.min("_right").alias("always_correct"), flips.alias("flips"), F.min(F.when(F.col("_right"), F.col("_k"))).alias("first_correct"),
        F.max(F.when(~F.col("_right"), F.col("_k"))).alias("last_incorrect"), F.coalesce(F.max(~F.col("_right") & (F.col("_was") == 1)), F.lit(False)).alias("regressed"),
        F.when(n < 2, 1.0).otherwise(1 - flips / F.greatest(n - 1, F.lit(1))).alias("stability"), F.avg("confidence").alias("mean_confidence"), F.max_by("_right", "_k").alias("_last"),
    )
    return s


def difficulty_scores(history: DataFrame, epochs: int) -> DataFrame:
    """(sample_id, difficulty): mean of first correct epoch / epochs (1 if never), 1 - stability, and 0.5 if wrong at the end."""
    s = per_sample(history)
    first = F.coalesce(F.col("first_correct") / max(epochs, 1), F.lit(1.0))
    return s.select("sample_id", ((first + 1 - F.col("stability") + F.when(F.col("_last"), 0.0).otherwise(0.5)) / 3).alias("difficulty"))


def summary(history: DataFrame, unstable: float = 0.7) -> DataFrame:
    s = per_sample(history)
    count = lambda c: F.sum(c.cast("long"))
    return s.agg(
        F.count(F.lit(1)).alias("samples"),
        count(~F.col("ever_correct")).alias("never_correct"),
        count(F.col("always_correct")).alias("always_correct"),
        count(F.col("regressed")).alias("regressed"),
        count(F.col("stability") < unstable).alias("unstable"),
        F.avg("stability").alias("mean_stability"),
    )


def class_weights(df: DataFrame, label: str = "label", beta: float | None = None) -> DataFrame:
    """(label, n, weight): n / (classes n_c), or with ``beta`` by effective numbers (1 - beta^n) / (1 - beta), whose total over (classes x own) it is."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n").cast("double") if beta is None else (1 - F.pow(F.lit(beta), F.col("n"))) / (1 - beta)
    e = c.withColumn("_e", own)
    w = Window.partitionBy()  # a row a class
    return e.select(label, "n", (F.sum("_e").over(w) / (F.count(F.lit(1)).over(w) * F.col("_e"))).alias("weight"))


def sample_weights(df: DataFrame, label: str = "label", beta: float | None = None) -> DataFrame:
    """Adds ``weight``, the class weight of the row scaled to a mean of 1 over all rows."""
    c = class_weights(df, label, beta)
    mean = c.agg(F.sum(F.col("n") * F.col("weight")) / F.sum("n")).first()[0]
    return df.join(c.select(F.col(label).alias("_l"), F.col("weight").alias("_w")), df[label].eqNullSafe(F.col("_l"))).withColumn("weight", F.col("_w") / F.lit(mean)).drop("_l", "_w")


def curriculum_weights(df: DataFrame, easy_first: bool = True, loss: str = "loss", id_col: str = "sample_id") -> DataFrame:
    """Adds ``weight``: 1 - 0.9 rank / n in order of loss (ties by id), scaled to a mean of 1.

    Beyond the rows of one range, those of equal loss are counted by ranges of the id and different losses by ranges
    of the loss, so neither many rows nor a loss of very many rows come to one task. ``df`` is read a few times.
    """
    n = df.count()
    at, mean = cuts(df, id_col, n), 1 - 0.9 * (n - 1) / (2 * n or 1)
    if not at:
        k = F.row_number().over(Window.orderBy(F.col(loss) if easy_first else -F.col(loss), id_col)) - 1
        return df.withColumn("weight", (1 - 0.9 * (k / (n or 1))) / mean)
    rows = in_ranges(df, id_col, at, "_q")
    w = Window.partitionBy(loss).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(loss, "_q").agg(F.count(F.lit(1)).alias("_n")).withColumn("_same", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    values = cells.groupBy(loss).agg(F.sum("_n").alias("_n")).withColumn("_order", F.col(loss) if easy_first else -F.col(loss))
    cut = in_ranges(values, "_order", cuts(values, "_order", n))
    inside = Window.partitionBy("_r").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    less = cut.withColumn("_here", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(before(cut, [], F.col("_n"))), "_r")
    less = less.select(F.col(loss).alias("_l"), (F.col("_before") + F.col("_here")).alias("_less"))
    places = cells.join(less, F.col(loss).eqNullSafe(F.col("_l"))).select("_l", F.col("_q").alias("_p"), (F.col("_less") + F.col("_same")).alias("_first"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(loss, "_q").orderBy(id_col)))
    k = numbered.join(places, F.col(loss).eqNullSafe(F.col("_l")) & (F.col("_q") == F.col("_p")))
    raw = 1 - 0.9 * ((F.col("_first") + F.col("_k") - 1) / n)
    return k.withColumn("weight", raw / mean).select(*df.columns, "weight")


def curriculum_share(epoch, epochs: int, start: float = 0.2, end: float = 1.0):
    """Share of the data in use at an epoch: a straight line from ``start`` to ``end`` over the training."""
    return start + (end - start) * F.least(epoch / max(epochs - 1, 1), F.lit(1.0))


def best_epoch(history: DataFrame, metric: str = "valid_loss", lower_is_better: bool = True) -> DataFrame:
    """One row: the first epoch of the best ``metric`` of a history (epoch, metric), and its value; NaN never is best."""
    h = history.where(~F.isnan(metric) & F.col(metric).isNotNull())
    best = F.min_by if lower_is_better else F.max_by
    key = F.struct(F.col(metric), F.col("epoch") if lower_is_better else -F.col("epoch"))
    return h.agg(best("epoch", key).alias("epoch"), best(metric, key).alias("value"))


def early_stopping(history: DataFrame, patience: int, min_delta: float = 0.0, metric: str = "valid_loss", lower_is_better: bool = True) -> DataFrame:
    """One row: the epoch at which training stops, or null: more than ``patience`` - 1 epochs in a row no better than the best by ``min_delta``, or a NaN.

    A history has a row an epoch, so one task may fold it; runs are told apart by ``run_id`` where it has one.
    """
    by = ["run_id"] if "run_id" in history.columns else []
    rows = F.array_sort(F.collect_list(F.struct("epoch", F.col(metric).cast("double").alias("m"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def step(a, x):
        better = a["best"].isNull() | (x["m"] < a["best"] - min_delta if lower_is_better else x["m"] > a["best"] + min_delta)
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        stop = F.coalesce(a["stop"], F.when(F.isnan(x["m"]) | (bad >= patience), x["epoch"].cast("long")))
        return F.struct(F.when(better, x["m"]).otherwise(a["best"]).alias("best"), bad.alias("bad"), stop.alias("stop"))

    return history.groupBy(*by).agg(F.aggregate(rows, start, step, lambda a: a["stop"]).alias("stop_epoch"))


def most_confident(preds: DataFrame, n: int, k: int) -> DataFrame:
    """The first ``k`` of ``n`` rows by falling ``prob``, then by numeric ``sample_id``; ``preds`` is read a few times.

    Only ``prob``, and for ties at the cut ``sample_id``, is ranked, by ranges; whole rows are filtered where they are.
    """
    if k >= n:
        return preds
    at = F.lit(rank_by_id(preds.select("prob"), "prob", n=n).where(F.col("rank") == n - k).first().prob)
    tied = preds.where(F.col("prob") == at)
    more, ties = preds.agg(F.count(F.when(F.col("prob") > at, 1)), F.count(F.when(F.col("prob") == at, 1))).first()
    if more + ties == k:
        return preds.where(F.col("prob") >= at)
    own, left = F.col("sample_id"), k - more
    last = F.lit(rank_by_id(tied.select("sample_id"), "sample_id", n=ties).where(F.col("rank") == left - 1).first().sample_id)
    earlier = (own < last) | (own.isNull() & last.isNotNull())
    same = tied.where(own.eqNullSafe(last))
    taken = preds.where((F.col("prob") > at) | ((F.col("prob") == at) & F.coalesce(earlier, F.lit(False))))
    return taken.unionByName(same.limit(left - tied.where(earlier).count()))  # rows of one id and one confidence


def pseudo_labels(preds: DataFrame, how: str = "threshold", threshold: float = 0.9, fraction: float = 0.5, per_class: int = 10, least: float = 0.0) -> DataFrame:
    """Rows of (sample_id, pred, prob) to take as labelled, with weight = confidence: ``all``, ``threshold``, ``topk`` (max(1, round(n fraction)) most confident) or ``balanced`` (``per_class`` a class)."""
    ok = preds.where(F.col("prob") >= least)
    if how == "threshold":
        ok = ok.where(F.col("prob") >= threshold)
    elif how == "topk":
        n = ok.count()
        ok = most_confident(ok, n, max(1, int(n * fraction + 0.5)))
    elif how == "balanced":
        k = F.row_number().over(Window.partitionBy("pred").orderBy(F.desc("prob"), "sample_id"))
        ok = ok.withColumn("_k", k).where(F.col("_k") <= per_class).drop("_k")
    elif how != "all":
        raise ValueError(f"unknown strategy {how}")
    return ok.withColumn("weight", F.col("prob"))


def clipped_gradients(df: DataFrame, most: float, how: str = "norm", gradient: str = "gradient") -> DataFrame:
    """Adds ``norm`` and ``clipped``, and limits the array column ``gradient``: by its Euclidean ``norm``, which keeps the direction, or each ``value``."""
    if how not in ("norm", "value"):
        raise ValueError("how is norm or value")
    norm = F.sqrt(F.aggregate(gradient, F.lit(0.0), lambda a, v: a + v * v))
    over = F.col("norm") > most if how == "norm" else F.exists(gradient, lambda v: F.abs(v) > most)
    scaled = F.transform(gradient, lambda v: v * most / F.col("norm")) if how == "norm" else F.transform(gradient, lambda v: F.greatest(F.least(v, F.lit(most)), F.lit(-most)))
    return df.withColumn("norm", norm).withColumn("clipped", over).withColumn(gradient, F.when(F.col("clipped"), scaled).otherwise(F.col(gradient)))


def clip_statistics(clipped: DataFrame, *by: str) -> DataFrame:
    """(batches, n_clipped, share, mean_norm, max_norm) of ``clipped_gradients``, a row a batch."""
    n = F.sum(F.col("clipped").cast("long"))
    return clipped.groupBy(*by).agg(F.count(F.lit(1)).alias("batches"), n.alias("n_clipped"), (n / F.count(F.lit(1))).alias("share"), F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm"))
