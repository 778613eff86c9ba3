"""Classification and regression metrics of a predictions frame (label, pred, ...), as aggregations.

Everything with classes starts from counts by (label, pred), a table of at most C x C rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.ranges import before, cuts, in_ranges


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(preds: DataFrame) -> DataFrame:
    """(label, pred, n) of the pairs that occur."""
    return preds.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(preds: DataFrame, n_classes: int) -> DataFrame:
    """Every pair of classes with its count and its share of the label's row; pairs out of range are dropped."""
    spark = preds.sparkSession
    grid = spark.range(n_classes * n_classes).select(F.floor(F.col("id") / n_classes).cast("int").alias("label"), (F.col("id") % n_classes).cast("int").alias("pred"))
    counted = confusion(preds.select(F.col("label").cast("int"), F.col("pred").cast("int")))
    whole = F.sum("n").over(Window.partitionBy("label"))
    counted = counted.where(F.col("label").between(0, n_classes - 1) & F.col("pred").between(0, n_classes - 1))
    return grid.join(counted, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n")).withColumn("share", _ratio(F.col("n"), whole))


def per_class(preds: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support, predicted) for the union of true and predicted classes; zero where undefined."""
    c = confusion(preds)
    none, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(0)
    of_label = F.struct(F.col("label").alias("class"), n.alias("support"), none.alias("predicted"), hit.alias("hit"))
    of_pred = F.struct(F.col("pred").alias("class"), none.alias("support"), n.alias("predicted"), none.alias("hit"))
    each = c.select(F.explode(F.array(of_label, of_pred)).alias("e")).select("e.*")
    s = each.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "hit")])
    p, r = _ratio(F.col("hit"), F.col("predicted")), _ratio(F.col("hit"), F.col("support"))
    return s.select("class", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), "support", "predicted", "hit")


def report(preds: DataFrame) -> DataFrame:
    """One row: accuracy, macro averages over classes with support, and support-weighted averages."""
    c = per_class(preds)
    has, n = F.col("support") > 0, F.sum("support")
    macro = [F.avg(F.when(has, F.col(m))).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(m) * F.col("support")) / n).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return c.agg((F.sum("hit") / n).alias("accuracy"), *macro, *weighted, n.alias("support"))


def macro_scores(preds: DataFrame, n_classes: int | None = None) -> DataFrame:
    """One row with the differing macro averages: F1 and recall over classes in the labels, precision over predicted classes, and F1 over all ``n_classes``."""
    c = per_class(preds)
    in_labels, in_preds = F.col("support") > 0, F.col("predicted") > 0
    out = [
        F.avg(F.when(in_labels, F.col("f1"))).alias("f1_in_labels"),
        F.avg(F.when(in_labels, F.col("recall"))).alias("recall_in_labels"),
        F.avg(F.when(in_preds, F.col("precision"))).alias("precision_in_predictions"),
    ]
    if n_classes:
        out.append((F.sum("f1") / n_classes).alias("f1_all_classes"))
    return c.agg(*out)


def extreme_classes(preds: DataFrame) -> DataFrame:
    """One row: the class with support of lowest F1 (the first of ties) and of highest (the last)."""
    c = per_class(preds).where("support > 0")
    return c.agg(F.min_by("class", F.struct("f1", "class")).alias("worst"), F.max_by("class", F.struct("f1", "class")).alias("best"))


def mcc(preds: DataFrame) -> DataFrame:
    """Matthews correlation, multiclass form; with two classes it equals the binary one. Products are of doubles, which counts can't overflow."""
    hit, t, p = (F.col(c).cast("double") for c in ("hit", "support", "predicted"))
    c = per_class(preds).agg(F.sum(hit).alias("c"), F.sum(t).alias("n"), F.sum(t * p).alias("pt"), F.sum(p * p).alias("pp"), F.sum(t * t).alias("tt"))
    s = F.col("n") * F.col("n")
    return c.select(_ratio(F.col("c") * F.col("n") - F.col("pt"), F.sqrt((s - F.col("pp")) * (s - F.col("tt")))).alias("mcc"))


def auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC of rows (positive BOOLEAN, score) with tied ranks averaged, 0.5 where a class is missing; for each group of ``by``.

    Equal scores are counted first, and ranks come from counts by ranges of the score, so no task sees all scores.
    """
    by = by or []
    ties = scores.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    at = cuts(ties, "score", scores.count())
    cut = in_ranges(ties, "score", at)
    inside = Window.partitionBy(*by, *(["_r"] if at else [])).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    here = cut.withColumn("_here", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    here = here.join(before(cut, by, F.col("n")), [*by, "_r"]) if at else here.withColumn("_before", F.lit(0))
    ranked = here.select(*by, "n", "p", (F.col("_before") + F.col("_here") + (F.col("n") + 1) / 2).alias("rank"))
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    s = ranked.groupBy(*by).agg(F.sum(p * F.col("rank")).alias("r"), F.sum(p).alias("p"), F.sum(n).alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    both = (p > 0) & (q > 0)
    return s.select(*by, F.when(both, (F.col("r") - p * (p + 1) / 2) / (p * q)).otherwise(0.5).alias("auc"), both.alias("both"))


def auc_one_vs_rest(probs: DataFrame) -> DataFrame:
    """Macro AUC over classes that have both kinds of label; 0.5 without any. ``probs``: (label, probs)."""
    each = probs.select("label", F.posexplode("probs").alias("class", "score")).select("class", (F.col("label") == F.col("class")).alias("positive"), "score")
    return auc(each, ["class"]).agg(F.coalesce(F.avg(F.when(F.col("both"), F.col("auc"))), F.lit(0.5)).alias("auc"))


def regression(df: DataFrame, pred: str = "pred", target: str = "target", eps: float = 1e-8) -> DataFrame:
    """One row: mse, mae, rmse, mape (percent, over targets beyond ``eps``), r2, and the share of pairs without NaN."""
    ok = ~(F.isnan(pred) | F.isnan(target) | F.col(pred).isNull() | F.col(target).isNull())
    d = F.when(ok, F.col(pred) - F.col(target))
    t = F.when(ok, F.col(target))
    sums = df.agg(
        F.avg(d * d).alias("mse"),
        F.avg(F.abs(d)).alias("mae"),
        F.coalesce(F.avg(F.when(F.abs(t) > eps, F.abs(d) / F.abs(t))) * 100, F.lit(0.0)).alias("mape"),
        F.sum(d * d).alias("_res"),
        (F.var_pop(t) * F.count(t)).alias("_tot"),
        F.avg(ok.cast("double")).alias("valid_fraction"),
    )
    return sums.select("mse", "mae", F.sqrt("mse").alias("rmse"), "mape", (1 - F.col("_res") / (F.col("_tot") + 1e-8)).alias("r2"), "valid_fraction")


def top_losses(df: DataFrame, k: int, loss: str = "loss", id_col: str = "sample_id") -> DataFrame:
    """The k rows of highest loss; ties by id."""
    return df.orderBy(F.desc_nulls_last(loss), id_col).limit(k)


def common_confusions(preds: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent wrong pairs with their share of all errors."""
    wrong = confusion(preds).where("label <> pred")
    return wrong.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "label", "pred").limit(k)


def errors_by_class(preds: DataFrame) -> DataFrame:
    """(label, errors, total, rate)."""
    wrong = F.sum((F.col("label") != F.col("pred")).cast("long"))
    return preds.groupBy("label").agg(wrong.alias("errors"), F.count(F.lit(1)).alias("total"), (wrong / F.count(F.lit(1))).alias("rate"))


def class_stats(preds: DataFrame) -> DataFrame:
    """(label, n, accuracy, mean_confidence, mean_loss) of rows with prob and loss."""
    return preds.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.avg("prob").alias("mean_confidence"), F.avg("loss").alias("mean_loss"))


def difficulty(preds: DataFrame) -> DataFrame:
    """Adds ``bucket``: easy (right, confidence 0.9 or more), hard (wrong, or below 0.6), else medium."""
    right = F.col("label") == F.col("pred")
    return preds.withColumn("bucket", F.when(right & (F.col("prob") >= 0.9), "easy").when(~right | (F.col("prob") < 0.6), "hard").otherwise("medium"))


def evaluate(preds: DataFrame) -> DataFrame:
    """One row of (label, pred): accuracy, macro and weighted averages, and Matthews correlation."""
    return report(preds).crossJoin(mcc(preds))  # two single rows


def binary_scores(preds: DataFrame, eps: float = 1e-8) -> DataFrame:
    """One row of the notebook's two-class metrics of (label, pred) in 0 and 1, with ``eps`` in each denominator."""
    hit = lambda y, p: F.sum(((F.col("label") == y) & (F.col("pred") == p)).cast("double"))
    c = preds.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(((F.col("tp") + F.col("tn")) / total).alias("accuracy"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + eps)).alias("f1"))


def label_cardinality(targets: DataFrame, y: str = "y") -> DataFrame:
    """One row: least, greatest and mean number of positive labels of a multi-label row."""
    n = F.aggregate(F.col(y), F.lit(0.0), lambda a, v: a + v)
    return targets.select(n.alias("n")).agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"))


def label_frequency(targets: DataFrame, y: str = "y") -> DataFrame:
    """(label, n, percent) of each place of a multi-label array."""
    each = targets.select(F.posexplode(y).alias("label", "v")).groupBy("label")
    return each.agg(F.sum("v").alias("n"), (F.avg("v") * 100).alias("percent"))
