"""Gradient training, attributions of a fitted head, search over folds and self-training."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import dynamics, explain, metrics, search, splits
from panelwright.operators.gradient import GradientTrainer, RAdam
from panelwright.operators.heads import MixedModel
from panelwright.operators.self_training import NoisyStudent
from panelwright.plans.registry import query
from panelwright.plans.tables import E, r, rr, vectors
from panelwright.session import stored

#: The first rectified step is plain: against the mean gradient, which from zero weights is (1 / classes - [label = c]) x.
_FIRST = f"{E}, w AS (SELECT c::INT AS c, t, -0.5::DOUBLE * avg((0.1::DOUBLE - (label = c)::INT) * v) AS w FROM e, range(10) AS k(c) GROUP BY 1, 2)"


def _rows(spark, sf_dir):
    return vectors(spark, sf_dir).select("sample_id", F.col("x").alias("features"), "label")


def _first_step(spark, sf_dir) -> GradientTrainer:
    return GradientTrainer(64, 10, rounds=1, lr=0.5, optimiser=RAdam, schedule=lambda k, lr, n: lr).fit(_rows(spark, sf_dir))


@query("train_first_step", f"WITH {_FIRST} SELECT c AS class, t AS feature, {rr('w', 9)} AS weight FROM w")
def train_first_step(spark, sf_dir):
    t = _first_step(spark, sf_dir)
    w = t.network.layers(t.weights)[0][1:]
    return spark.createDataFrame([(c, j, float(w[j, c])) for c in range(10) for j in range(64)], "class int, feature int, weight double").withColumn("weight", r("weight", 9))


@query("integrated_gradients", f"WITH {_FIRST} SELECT sample_id, e.t, {rr('v * w', 8)} AS attribution FROM e JOIN w ON w.c = e.label AND w.t = e.t")
def integrated_gradients(spark, sf_dir):
    """Of the score of each row's label, by the head after one step; for a linear head value times weight."""
    t = _first_step(spark, sf_dir)
    network, weights = t.network, t.weights
    got = explain.integrated_over_rows(_rows(spark, sf_dir), lambda x, aim: network.input_gradient(weights, x, aim), target="label", steps=10)
    return got.select("sample_id", F.posexplode("attribution").alias("t", "v")).select("sample_id", "t", r("v", 8).alias("attribution"))


def _attention(spark, sf_dir):
    """Each vector as attention (layer, head, query, key) of 4 x 1 x 4 x 4 values."""
    cut = lambda x, n: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(x, i * n + 1, F.lit(n)))
    layers = F.transform(cut("x", 16), lambda layer: F.array(cut(layer, 4)))
    return vectors(spark, sf_dir).select("sample_id", layers.alias("attention"))


def _keys(found):
    return found.select("sample_id", F.posexplode("attribution").alias("k", "v")).select("sample_id", F.col("k").alias("t"), r("v").alias("attribution"))


@query("attention_mean", f"WITH {E} SELECT sample_id, (t % 4)::INT AS t, {rr('sum(v) / 4')} AS attribution FROM e GROUP BY 1, 2")
def attention_mean(spark, sf_dir):
    return _keys(explain.attention_over_rows(_attention(spark, sf_dir), "mean"))


@query("attention_last", f"WITH {E} SELECT sample_id, (t % 4)::INT AS t, {rr('sum(v)')} AS attribution FROM e WHERE t >= 48 GROUP BY 1, 2")
def attention_last(spark, sf_dir):
    return _keys(explain.attention_over_rows(_attention(spark, sf_dir), "last"))


_FOLDS = f"""
WITH t AS (SELECT embedding[1]::DOUBLE AS y, (row_number() OVER (ORDER BY vec_id) - 1) AS k, count(*) OVER () AS n FROM embeddings),
f AS (SELECT f, n, 102 + f * ((n - 102) // 4) AS ts FROM range(4) AS q(f), (SELECT count(*) AS n FROM embeddings)),
m AS (SELECT f, ts, avg(y) AS m FROM t, f WHERE k < ts - 2 GROUP BY 1, 2),
s AS (SELECT f, s, -avg((y - s * m) ** 2) AS score FROM m, t, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS s) WHERE k >= ts AND k < ts + 50 GROUP BY 1, 2)
SELECT s AS shrink, count(*) AS folds, {rr('avg(score)', 9)} AS score FROM s GROUP BY 1
"""


def _shrunk_mean(point, train, test) -> float:
    mean = train.agg(F.avg("y")).first()[0]
    return -test.agg(F.avg((F.col("y") - point["shrink"] * mean) ** 2)).first()[0]


@query("search_folds", _FOLDS)
def search_folds(spark, sf_dir):
    """Trials that predict the later values by a share of the mean of the earlier ones, over expanding folds, four at a time."""
    rows = vectors(spark, sf_dir).select("sample_id", F.get("x", F.lit(0)).alias("y"))
    n = rows.count()
    folds = splits.walk_forward_folds(rows, splits.walk_forward(n, 4, 100, 50, gap=2))
    found = search.search_folds(spark, [{"shrink": s} for s in (0.0, 0.5, 1.0, 2.0)], folds, _shrunk_mean)
    scored = search.mean_scores(found)
    return scored.select(F.get_json_object("params", "$.shrink").cast("double").alias("shrink"), "folds", r("score", 9).alias("score"))


@query("self_training")
def self_training(spark, sf_dir):
    """Statistics of three rounds: every tenth label is known, the others are learned from confident predictions."""
    rows = stored(_rows(spark, sf_dir).repartition("sample_id"), "rows")  # every round reads it, and a file may be one task's
    labelled, held = (rows.where(F.col("sample_id") % 10 == i) for i in (0, 1))
    other = rows.where(F.col("sample_id") % 10 > 1).drop("label")
    fit = lambda data, k: GradientTrainer(64, 10, rounds=10, lr=0.5).fit(data)
    student = NoisyStudent(fit, rounds=3, how="topk", settings={"fraction": 0.3}, noise=0.02)
    student.fit(labelled, other, held)
    return student.table(spark)


_CLIP = "WITH g AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings)"


@query("gradient_clip", _CLIP + f" SELECT label, count(*) AS batches, count(*) FILTER (WHERE norm > 1) AS n_clipped, {rr('count(*) FILTER (WHERE norm > 1) / count(*)')} AS share, {rr('avg(norm)')} AS mean_norm, {rr('max(norm)')} AS max_norm, {rr('sum(embedding[1]::DOUBLE * CASE WHEN norm > 1 THEN 1 / norm ELSE 1 END)')} AS first FROM g GROUP BY 1")
def gradient_clip(spark, sf_dir):
    """Statistics of clipping to a norm of 1, and the sum of what is left of the first components."""
    g = dynamics.clipped_gradients(vectors(spark, sf_dir).select("label", F.col("x").alias("gradient")), 1.0)
    firsts = g.groupBy("label").agg(r(F.sum(F.get("gradient", F.lit(0)))).alias("first"))
    s = dynamics.clip_statistics(g, "label").join(firsts, "label")
    return s.select("label", "batches", "n_clipped", r("share").alias("share"), r("mean_norm").alias("mean_norm"), r("max_norm").alias("max_norm"), "first")


def _mixed_table(spark, sf_dir):
    """Series with a number and a category; the label is whether the series' mean and the category agree."""
    v = vectors(spark, sf_dir)
    mean = F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / F.size("x")
    label = ((mean > 0) == (F.col("label") % 2 == 0)).cast("int")
    return v.select("sample_id", "var_id", "x"), v.select("sample_id", F.get("x", F.lit(0)).alias("number"), (F.col("label") % 2).cast("string").alias("kind"), label.alias("label"))


@query("mixed_classifier")
def mixed_classifier(spark, sf_dir):
    """Held-out report of a perceptron over series features and columns, whose rule no linear head can learn."""
    panel, rows = _mixed_table(spark, sf_dir)
    fitted = MixedModel("mlp", numeric=("number",), categorical=("kind",), hidden=(8,), max_iter=60).fit(panel, rows.where(F.col("sample_id") % 3 != 0))
    test = rows.where(F.col("sample_id") % 3 == 0)
    return metrics.evaluate(fitted.predict(panel, test).join(test.select("sample_id", "label"), "sample_id"))


@query("forest_importances")
def forest_importances(spark, sf_dir):
    """What a boosted regressor of the series' second value looks at."""
    panel, rows = _mixed_table(spark, sf_dir)
    target = panel.select("sample_id", F.get("x", F.lit(1)).alias("label")).join(rows.drop("label"), "sample_id")
    return MixedModel("boosted", "value", numeric=("number",), categorical=("kind",), trees=5, depth=3).fit(panel, target).importances()
