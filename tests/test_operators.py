import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import calibration, dynamics, explain, metrics, rocket, schedules, search, splits, windows
from panelwright.operators import transforms as T


def rows(spark, n, label=3):
    return spark.range(n).select(F.col("id").alias("sample_id"), (F.col("id") % label).alias("label"))


def test_split_sizes_and_errors(spark):
    got = {r.split: r["count"] for r in splits.random_split(rows(spark, 100), 0.2).groupBy("split").count().collect()}
    assert got == {"train": 80, "test": 20}
    for bad in (0, 1):
        with pytest.raises(ValueError):
            splits.random_split(rows(spark, 10), bad)
    with pytest.raises(ValueError):
        splits.walk_forward(10, 5, 5, 3)


def test_batches(spark):
    assert splits.batches(rows(spark, 100), 32).select("batch_id").distinct().count() == 4
    assert splits.batches(rows(spark, 100), 32, drop_last=True).select("batch_id").distinct().count() == 3


def test_ranks_are_a_permutation(spark):
    got = splits.batches(rows(spark, 500), 1, shuffle=True).select("batch_id").collect()
    assert sorted(r[0] for r in got) == list(range(500))
    per = splits.class_rank(rows(spark, 90), 1).groupBy("label").agg(F.max("class_rank").alias("m"), F.countDistinct("class_rank").alias("n")).collect()
    assert all((r.m, r.n) == (29, 30) for r in per)


def test_windows_of_short_series(spark):
    df = spark.createDataFrame([(0, 0, [1.0] * 5), (1, 0, [1.0] * 20)], "sample_id long, var_id int, x array<double>")
    assert windows.sliding_windows(df, 8, 4, 4).count() == 3
    with pytest.raises(ValueError):
        windows.sliding_windows(df, 8, 0)


def test_confusion_and_calibration(spark):
    p = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (1, 1)], "label int, pred int")
    assert {(r.label, r.pred): r.n for r in metrics.confusion(p).collect()} == {(0, 0): 1, (1, 1): 2, (1, 0): 1}
    assert metrics.report(p).first().accuracy == 0.75
    sure = spark.createDataFrame([(1, 1, 1.0)] * 4, "label int, pred int, prob double")
    assert calibration.errors(sure).first().ece == 0


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 0.5)], "positive boolean, score double")
    assert metrics.auc(df).first().auc == 0.5
    assert metrics.auc(df.where("positive")).first().auc == 0.5


def test_one_cycle_peak(spark):
    lr = {r.id: r.lr for r in spark.range(1000).select("id", schedules.one_cycle(F.col("id"), 1e-3, 1000).alias("lr")).collect()}
    assert lr[300] == pytest.approx(1e-3) and lr[999] < lr[0] < 1e-3


def test_plateau():
    s = schedules.PlateauReducer(1.0, 0.5, patience=1)
    assert [s.step(m) for m in (1.0, 1.0, 1.0, 1.0)] == [1.0, 1.0, 0.5, 0.5]


def test_dynamics(spark):
    h = spark.createDataFrame([(0, e, p, 1, 0.5) for e, p in enumerate([0, 1, 0, 1])], "sample_id long, epoch int, pred int, true_label int, confidence double")
    r = dynamics.per_sample(h).first()
    assert (r.flips, r.first_correct, r.last_incorrect, r.regressed, r.stability) == (3, 1, 2, True, 0.0)


@pytest.mark.parametrize("name", sorted(T.REGISTRY))
def test_transforms_keep_length_and_pass_validation(spark, name):
    df = spark.createDataFrame([(i, v, [float(i + t * (v + 1)) for t in range(24)]) for i in range(3) for v in range(2)], "sample_id long, var_id int, x array<double>")
    extra = {"n_vars": 2} if name in ("var_out", "frequency_mask") else {}
    out = T.REGISTRY[name](df, p=1, **extra).collect()
    assert len(out) == 6 and all(len(r.x) == 24 and None not in r.x for r in out)
    assert T.REGISTRY[name](df, p=1, split="valid", **extra) is df


def test_compositions(spark):
    df = spark.createDataFrame([(i, v, [float((i * 7 + t * 3 + v) % 11) for t in range(24)]) for i in range(3) for v in range(3)], "sample_id long, var_id int, x array<double>")
    assert all(len(r.x) == 24 for r in T.rand_augment(df, 3, 0.5).collect())
    assert T.spec_augment(df, n_vars=3, freq_mask_param=2, time_mask_param=5).count() == 9
    got = {(r.sample_id, r.var_id): r.x for r in T.shuffle_highs_lows(df).collect()}
    assert all(h >= lo for i in range(3) for h, lo in zip(got[i, 1], got[i, 2], strict=True))


def test_kernels_match_plain_convolution():
    x, w = np.arange(20.0)[None], np.array([1.0, -2.0, 0.5])
    y = rocket.convolve(x, w, 2, 0)[0]
    assert np.allclose(y, [sum(w[i] * x[0, t + 2 * i] for i in range(3)) for t in range(16)])
    assert rocket.convolve(x, np.ones(9), 4, 0).shape[1] == 0
    assert len({tuple(w) for w, *_ in rocket.minirocket_bank(84, 50)}) == 84


def test_attributions():
    g = explain.integrated_gradients(np.array([1.0, 2.0]), np.zeros(2), lambda z: 2 * z)
    assert np.allclose(g, [1, 4])
    assert np.allclose(explain.attention_rollout([np.full((2, 3, 3), 1 / 3)] * 2).sum(axis=1), 1)


def test_search():
    best = search.successive_halving(search.grid({"a": [1, 2, 3, 4, 5, 6, 7, 8, 9]}), lambda p, b: p["a"] * b, 1)
    assert best[0] == ({"a": 9}, 81) and len(best) == 13
    capped = search.successive_halving(search.grid({"a": [1, 2, 3, 4, 5, 6, 7, 8, 9]}), lambda p, b: p["a"] / b, 1, max_budget=3)
    assert capped[0] == ({"a": 9}, 9.0) and len(capped) == 12
    assert search.grid({"lr": (0.0, 1.0), "n": (1, 2)})[1] == {"lr": 0.0, "n": 2} and len(search.grid({"lr": (0.0, 1.0)})) == 5
    assert all(1e-4 <= p["lr"] <= 1e-1 and 1 <= p["n"] <= 3 for p in search.random_points({"lr": ("log", 1e-4, 1e-1), "n": (1, 3)}, 50))


def test_importance(spark):
    from panelwright.operators import metrics

    rows = [(i, [float(i % 2), float(i % 3)], float(i % 2), float(i % 5), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, x array<double>, a double, b double, label int")
    score = lambda d: metrics.evaluate(d.selectExpr("label", "cast(a AS INT) AS pred")).first().accuracy
    first, second = explain.permutation_importance(df, ["b", "a"], score, repeats=2)
    assert first[0] == "a" and 0.3 < first[1] < 0.7 and second == ("b", 0.0, 0.0)
    by_step = lambda d: metrics.evaluate(d.selectExpr("label", "cast(x[0] AS INT) AS pred")).first().accuracy
    assert [t for t, m, _ in explain.step_importance(df, [0, 1], by_step, repeats=1) if m > 0] == [0]


def waves(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    make = lambda c: (1 + c) * np.sin(np.arange(40) * (0.3 if c else 0.9) + rng.uniform(0, 6)) + rng.normal(0, 0.2, 40)
    rows = [(i, v, i % 2, [float(z) for z in make(i % 2)]) for i in range(n) for v in range(2)]
    return spark.createDataFrame(rows, "sample_id long, var_id int, label int, x array<double>")


@pytest.mark.parametrize("kind", ["statistics", "minirocket", "rocket", "multirocket", "hydra", "hydra_multirocket"])
def test_classifier_on_held_out_series(spark, tmp_path, kind):
    from panelwright.operators.training import SeriesClassifier

    train, test = waves(spark, 60), waves(spark, 40, 1)
    labels = lambda p: p.select("sample_id", "label").distinct()
    c = SeriesClassifier(kind, n_kernels=24, max_iter=20).fit(train, labels(train))
    preds, scores = c.evaluate(test, labels(test))
    assert preds.count() == 40 and scores.first().accuracy > 0.9
    if kind == "rocket":
        c.save(str(tmp_path / "model"))
        again = SeriesClassifier.load(str(tmp_path / "model")).predict(test).select("sample_id", "pred")
        assert again.exceptAll(preds.select("sample_id", "pred")).count() == 0


def test_regressor_and_forecaster(spark):
    from panelwright.operators.training import SeriesForecaster, SeriesRegressor

    p = waves(spark, 60)
    target = p.groupBy("sample_id").agg(F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("label"))
    preds, scores = SeriesRegressor("statistics").fit(p, target).evaluate(p, target)
    assert preds.count() == 60 and scores.first().r2 > 0.9
    rows = [(i, 0, [float(np.sin(0.3 * t + i)) for t in range(60)]) for i in range(20)] + [(99, 0, [1.0])]
    panel = spark.createDataFrame(rows, "sample_id long, var_id int, x array<double>")
    got = {r.sample_id: r.forecast for r in SeriesForecaster(12, 5, reg=1e-9).fit(panel).predict(panel).collect()}
    assert got[99] is None and all(np.allclose(got[i], [np.sin(0.3 * t + i) for t in range(60, 65)], atol=1e-3) for i in range(20))
    with pytest.raises(ValueError):
        SeriesForecaster(2, 2).fit_targets(spark.createDataFrame([([1.0, 2.0], [1.0])], "x array<double>, y array<double>"))


def test_ranks_of_any_ids(spark, monkeypatch):
    from panelwright.operators import ranges, splits

    monkeypatch.setattr(ranges, "ROWS_A_RANGE", 7)
    monkeypatch.setattr(splits, "ROWS_A_RANGE", 7)
    ids = [-(10**15), *range(300), 5 * 10**12 + 1, 5 * 10**12, 2**62, 2**62 + 1]
    df = spark.createDataFrame([(i, i % 3 if i % 2 else None) for i in ids], "sample_id long, label int")
    got = {r.sample_id: r.rank for r in splits.rank_by_id(df, "sample_id").collect()}
    assert [got[i] for i in sorted(ids)] == list(range(len(ids)))
    ranks = [r.class_rank for r in splits.class_rank(df, 1).where("label IS NULL").collect()]
    assert sorted(ranks) == list(range(len(ranks))) and len(ranks) > 100
    assert splits.rank_by_id(df.limit(0), "sample_id").count() == 0


def test_curriculum_and_auc_by_ranges(spark, monkeypatch):
    from panelwright.operators import metrics, ranges

    monkeypatch.setattr(ranges, "ROWS_A_RANGE", 5)
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.choice([0.0, 0.0, 0.5, rng.normal()])), bool(rng.integers(2))) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, loss double, positive boolean")
    for easy in (True, False):
        got = {r.sample_id: r.weight for r in dynamics.curriculum_weights(df, easy).collect()}
        order = sorted(rows, key=lambda r: (r[1] if easy else -r[1], r[0]))
        raw = {r[0]: 1 - 0.9 * k / 200 for k, r in enumerate(order)}
        assert all(abs(got[i] - w / (sum(raw.values()) / 200)) < 1e-9 for i, w in raw.items())
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(metrics.auc(df.selectExpr("positive", "loss AS score")).first().auc - want) < 1e-9


def test_samples_of_a_large_mean_are_standardised(spark):
    from panelwright.operators import preprocess

    df = spark.createDataFrame([(1, v, [1e9 + v, 1e9 + v + 1.0, 1e9 - v]) for v in range(2)], "sample_id long, var_id int, x array<double>")
    values = np.array([r.x for r in preprocess.standardize_samples(df).collect()])
    assert abs(values.mean()) < 1e-6 and abs(values.std() - 1) < 1e-6


def test_history_queries(spark):
    h = spark.createDataFrame([(e, v) for e, v in enumerate([3.0, 2.0, 1.0, 1.0, 1.5, 1.2, 0.9])], "epoch int, valid_loss double")
    assert tuple(dynamics.best_epoch(h.where("epoch < 6")).first()) == (2, 1.0)
    assert dynamics.early_stopping(h, 3).first().stop_epoch == 5 and dynamics.early_stopping(h, 4).first().stop_epoch is None
    nan = h.union(spark.createDataFrame([(7, float("nan"))], h.schema))
    assert dynamics.early_stopping(nan, 9).first().stop_epoch == 7


def test_ranges_follow_any_distribution(spark, monkeypatch):
    """No range holds more than twice its rows, whether values span many decades, lie beside one outlier or are all equal."""
    from panelwright.operators import ranges, splits

    monkeypatch.setattr(ranges, "ROWS_A_RANGE", 500)
    n = 20_000
    kinds = {"log": "pow(10D, 12 * id / 20000D)", "outlier": "IF(id = 7, 1e18D, id / 20000D)", "equal": "5D", "half": "IF(id % 2 = 0, 3D, id * 1D)"}
    for value in kinds.values():
        df = spark.range(n).selectExpr("id", f"{value} AS v")
        at = ranges.cuts(df, "v")
        sizes = ranges.in_ranges(df, "v", at, spread=F.xxhash64("id")).groupBy("_r").count().agg(F.max("count")).first()[0]
        assert sizes <= 2.2 * 500, value  # cut at approximate quantiles, dealt by a hash
        got = [r.v for r in splits.rank_by_id(df, "v").orderBy("rank").collect()]
        assert got == sorted(got) and len(got) == n
    shared = ranges.in_ranges(spark.range(n).selectExpr("id % 3 AS v"), "v", [0.0, 1.0, 1.0, 2.0])
    assert {(r.v, r._r) for r in shared.distinct().collect()} == {(0, 1), (1, 3), (2, 4)}
    odd = ranges.in_ranges(spark.sql("SELECT explode(array(double('nan'), null, 1D, -1D)) AS v"), "v", [0.0])
    assert {(str(r.v), r._r) for r in odd.collect()} == {("nan", 2), ("None", -1), ("1.0", 1), ("-1.0", 0)}
