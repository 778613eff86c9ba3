"""Gradient training, self-training, search in parallel and attributions of fitted heads."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import rand as R
from panelwright.operators import dynamics, explain, ranges, schedules, search, splits
from panelwright.operators.gradient import GradientTrainer, Network, RAdam, Ranger, Sgd, one_cycle
from panelwright.operators.self_training import NoisyStudent


def rows_of(spark, x, y, weight=None):
    w = np.ones(len(x)) if weight is None else weight
    return spark.createDataFrame([(i, a.tolist(), None if b is None else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))], "sample_id long, features array<double>, label double, weight double")


@pytest.mark.parametrize("optimiser", [Sgd, RAdam, Ranger, lambda: Ranger(k=3, decay=1e-3)])
@pytest.mark.parametrize("hidden", [(), (5,)])
def test_rounds_equal_plain_numpy(spark, optimiser, hidden):
    rng = np.random.default_rng(0)
    x, weight = rng.normal(size=(60, 4)), rng.uniform(0.5, 2, 60)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int) + (x[:, 2] > 1)
    data = rows_of(spark, x, y, weight).repartition(5).cache()
    got = GradientTrainer(4, 3, hidden, rounds=20, lr=0.05, optimiser=optimiser).fit(data)
    net, plain = Network(4, hidden, 3), optimiser()
    w = net.start(42)
    for k in range(20):
        _, g = net.gradient(w, x, y, weight)
        w = plain.step(w, g / weight.sum(), one_cycle(k, 0.05, 20))
    assert np.abs(got.weights - w).max() < 1e-9 and len(got.history) == 20
    assert got.history[-1]["loss"] < got.history[0]["loss"]


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    for classes in (1, 3):
        net = Network(3, (4, 2), classes)
        w, x, y, weight = rng.normal(size=net.n), rng.normal(size=(6, 3)), rng.integers(0, max(2, classes), 6), rng.uniform(1, 2, 6)
        _, g = net.gradient(w, x, y.astype(float), weight)
        for i in rng.integers(0, net.n, 12):
            e = np.zeros(net.n)
            e[i] = 1e-6
            slope = (net.gradient(w + e, x, y.astype(float), weight)[0] - net.gradient(w - e, x, y.astype(float), weight)[0]) / 2e-6
            assert abs(slope - g[i]) < 1e-4
        aim = np.zeros(6, int)
        for j in range(3):
            d = np.zeros((6, 3))
            d[:, j] = 1e-6
            slope = (net.score(w, x + d, aim) - net.score(w, x - d, aim)) / 2e-6
            assert np.abs(slope - net.input_gradient(w, x, aim)[:, j]).max() < 1e-6


def test_one_cycle_equals_the_column(spark):
    got = spark.range(50).select(schedules.one_cycle(F.col("id"), 0.1, 50).alias("v")).collect()
    assert np.allclose([r.v for r in got], [one_cycle(k, 0.1, 50) for k in range(50)])


def test_early_stopping_keeps_the_best_weights(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 20))
    train, valid = rows_of(spark, x, rng.integers(0, 2, 40)).cache(), rows_of(spark, rng.normal(size=(40, 20)), rng.integers(0, 2, 40)).cache()
    t = GradientTrainer(20, 2, rounds=60, lr=0.5, optimiser=Sgd, schedule=lambda k, lr, n: lr, patience=3).fit(train, valid)
    losses = [h["valid_loss"] for h in t.history]
    assert len(losses) < 60 and min(losses) == losses[-5] and min(losses[-4:]) >= min(losses)
    from panelwright.operators.gradient import summed

    n, loss, _ = summed(t._rows(valid), t.network, t.weights)
    assert abs(loss / n - min(losses)) < 1e-12


def test_head_learns_a_rule_that_a_linear_one_cannot(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, size=(600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    train, test = rows_of(spark, x[:400], y[:400]).cache(), rows_of(spark, x[400:], y[400:]).cache()
    right = lambda t: t.predict(test).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    deep = GradientTrainer(2, 2, (12,), rounds=120, lr=0.2).fit(train)
    flat = GradientTrainer(2, 2, rounds=30, lr=0.2).fit(train)
    assert right(deep) > 0.9 > 0.7 > right(flat)
    odd = spark.createDataFrame([(1, None), (2, [0.5, 0.5])], "sample_id long, features array<double>")
    assert [(r.sample_id, r.pred) for r in deep.predict(odd).orderBy("sample_id").collect()] == [(1, None), (2, 1)]
    with pytest.raises(Exception, match="2 numbers"):
        deep.predict(spark.createDataFrame([([1.0],)], "features array<double>")).collect()
    with pytest.raises(ValueError):
        GradientTrainer(2).fit(train.where("label > 5"))


def test_attributions_add_up_on_every_row(spark):
    rng = np.random.default_rng(4)
    net = Network(5, (6,), 3)
    w = rng.normal(size=net.n)
    x, base, aim = rng.normal(size=(30, 5)), rng.normal(size=(30, 5)), rng.integers(0, 3, 30)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist(), int(c)) for i, (a, b, c) in enumerate(zip(x, base, aim))] + [(99, None, None, 0)], "sample_id long, features array<double>, base array<double>, pred int")
    got = {r.sample_id: r.attribution for r in explain.integrated_over_rows(rows, lambda z, t: net.input_gradient(w, z, t), baseline="base", steps=400).collect()}
    gain = net.score(w, x, aim) - net.score(w, base, aim)
    assert got.pop(99) is None and all(abs(sum(a) - gain[i]) < 1e-3 for i, a in got.items())
    plain = explain.integrated_gradients(x[0], base[0], lambda z: net.input_gradient(w, z[None], aim[:1])[0], 400)
    assert np.allclose(np.abs(got[0]), plain)


def test_attention_of_rows(spark):
    a = np.random.default_rng(5).dirichlet(np.ones(4), size=(3, 2, 4))
    rows = spark.createDataFrame([(1, a.tolist()), (2, None)], "sample_id long, attention array<array<array<array<double>>>>")
    for how, plain in (("mean", explain.attention_mean(list(a))), ("last", explain.attention_last(list(a))), ("rollout", explain.attention_rollout(list(a)).sum(axis=0))):
        got = {r.sample_id: r.attribution for r in explain.attention_over_rows(rows, how).collect()}
        assert np.allclose(got[1], plain) and got[2] is None


def test_student_learns_from_unlabelled_rows(spark):
    """Two clusters in ten dimensions of which twelve rows have labels."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 1200)
    x = rng.normal(size=(1200, 10))
    x[:, 0] += np.where(y == 1, 2.0, -2.0)
    labelled = rows_of(spark, x[:12], y[:12]).unionByName(spark.createDataFrame([(10_000, [9.0] * 10, None, 1.0)], "sample_id long, features array<double>, label double, weight double"))
    unlabelled, valid = rows_of(spark, x[100:800], y[100:800]).drop("label", "weight").cache(), rows_of(spark, x[800:], y[800:]).cache()
    student = NoisyStudent(lambda rows, k: GradientTrainer(10, 2, rounds=25, lr=0.3).fit(rows.cache()), rounds=3, settings={"threshold": 0.7}, noise=0.05)
    model = student.fit(labelled, unlabelled, valid)
    stats = student.table(spark).orderBy("round").collect()
    assert stats[0].labelled == 12 and stats[0].pseudo == 0 and len(stats) == 4
    assert all(s.valid_accuracy > stats[0].valid_accuracy for s in stats[1:]) and stats[-1].valid_accuracy > 0.94
    first = GradientTrainer(10, 2, rounds=25, lr=0.3).fit(rows_of(spark, x[:12], y[:12]))
    p = first.network.forward(first.weights, x[100:800])[1].max(axis=1)
    assert stats[1].pseudo == (p >= 0.7).sum() and abs(stats[1].mean_confidence - p[p >= 0.7].mean()) < 1e-9 and stats[1].changed == 1.0
    assert model.predict(valid).count() == 400
    none = NoisyStudent(lambda rows, k: GradientTrainer(10, 2, rounds=2).fit(rows), settings={"threshold": 1.1})
    none.fit(labelled, unlabelled)
    assert len(none.statistics) == 1


def ridge(point, train, test):
    if point["shrink"] < 0:
        raise RuntimeError("bad shrink")
    mean = train.agg(F.avg("y")).first()[0]
    return -test.agg(F.avg((F.col("y") - point["shrink"] * mean) ** 2)).first()[0]


def test_search_over_folds_in_parallel(spark):
    rows = spark.range(60).selectExpr("id AS sample_id", "5 + sin(id) AS y")
    folds = splits.walk_forward_folds(rows, splits.walk_forward(60, 3, 20, 10)).cache()
    points = [{"shrink": s} for s in (0.0, 0.5, 1.0, -1.0)]
    found = {n: search.search_folds(spark, points, folds, ridge, n) for n in (1, 4)}
    boards = {n: [tuple(r)[:3] for r in search.mean_scores(t).orderBy(F.desc_nulls_last("score"), "trial_id").collect()] for n, t in found.items()}
    assert boards[1] == boards[4] and boards[1][0][0] == 2 and boards[1][-1][2] is None
    assert found[4].where("error LIKE '%bad shrink%'").count() == 3


def test_halving_promotes_as_results_arrive(spark):
    """The same trials at any parallelism; a clear winner goes on while a slow trial of its round still runs, and runs overlap."""
    value = lambda p, b: float("nan") if p["v"] == 3 else p["v"] - 1 / b

    def slow(p, b):
        time.sleep({8: 1.2}.get(p["v"], 0.05) if b == 1 else 0.05)
        return value(p, b)

    points = [{"v": v} for v in (5, 1, 9, 8, 3, 7, 2, 4, 6)]
    shown = lambda t: [tuple(r) for r in t.select("trial_id", "budget", "score").orderBy("budget", "trial_id").collect()]
    one, four = (search.halving(spark, points, slow, 1, parallelism=n) for n in (1, 4))
    assert str(shown(one)) == str(shown(four)) and {r[1] for r in shown(one)} == {1, 3, 9}
    assert [r.trial_id for r in four.where("budget = 9").collect()] == [2]
    t = {(r.trial_id, r.budget): r for r in four.collect()}
    assert t[2, 3].started < t[3, 1].ended and max(r.ended for r in t.values()) - min(r.started for r in t.values()) < sum(r.ended - r.started for r in t.values())
    with_limit = search.halving(spark, points, value, 1, max_budget=3, maximise=False)
    assert with_limit.agg(F.max("budget")).first()[0] == 3 and not math.isnan(with_limit.where("budget = 3").agg(F.min("score")).first()[0])


def test_noise_is_drawn_once_a_round(spark):
    """However often a fit reads its rows, their noise is stored, not drawn again; the rows are the same."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), np.tile([0, 1], 30)
    plans, given = [], []

    def fit(rows, k):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        given.append({r.sample_id: r.features for r in rows.collect()})
        return GradientTrainer(4, 2, rounds=2).fit(rows)

    NoisyStudent(fit, rounds=1, how="all", noise=0.1).fit(rows_of(spark, x[:10], y[:10]), rows_of(spark, x, y).where("sample_id >= 10").drop("label", "weight"))
    assert "md5" not in plans[1] and len(given[1]) == 60
    draws = spark.range(10, 60).select("id", F.array(*[R.normal(43, "noise", F.col("id"), F.lit(i)) for i in range(4)]).alias("z")).collect()
    assert all(np.allclose(given[1][r.id], x[r.id] + 0.1 * np.array(r.z)) for r in draws)


@pytest.mark.parametrize("a_range", [1_000_000, 40])
def test_most_confident_rows_of_any_ties(spark, monkeypatch, a_range):
    """The share taken is that of a sort, and where nothing is tied no limit gathers the rows."""
    monkeypatch.setattr(ranges, "ROWS_A_RANGE", a_range)
    own = spark.range(200).select(F.col("id").alias("sample_id"), F.lit(0).alias("pred"), (F.pmod(F.col("id") * 37, F.lit(200)) / 200).alias("prob"))
    few, one = own.withColumn("prob", F.floor(F.col("prob") * 3) / 3), own.withColumn("prob", F.lit(0.5))
    twice = one.unionByName(one).withColumn("sample_id", F.floor(F.col("sample_id") / 50))
    odd = few.withColumn("sample_id", F.when(F.col("sample_id") > 20, F.col("sample_id"))).withColumn("prob", F.when(F.col("prob") > 0.6, float("nan")).otherwise(F.col("prob")))
    for rows in (own, few, one, twice, odd):
        for share in (0.001, 0.3):
            n = rows.count()
            want = rows.orderBy(F.desc("prob"), "sample_id").limit(max(1, int(n * share + 0.5)))
            got = dynamics.pseudo_labels(rows, "topk", fraction=share)
            shown = lambda df: sorted(map(str, df.select("sample_id", "prob").collect()))
            assert shown(got) == shown(want)
            if rows is own:
                assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
