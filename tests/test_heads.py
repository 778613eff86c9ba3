"""Heads over series and columns, the store of models, clipped gradients."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import dynamics, store
from panelwright.operators.heads import MixedModel


@pytest.fixture(scope="module")
def planted(spark):
    """The label is whether the sign of the series' mean and the category agree."""
    rng = np.random.default_rng(0)
    sign, kind = rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 2, 12)) * 0.3
    x[:, 0] += np.where(sign == 1, 1.0, -1.0)[:, None]
    panel = spark.createDataFrame([(i, v, x[i, v].tolist()) for i in range(300) for v in range(2)], "sample_id long, var_id int, x array<double>")
    table = spark.createDataFrame([(i, float(rng.normal()) if i % 7 else None, "ab"[kind[i]] if i % 50 else None, int(sign[i] == kind[i])) for i in range(300)], "sample_id long, size double, kind string, label int")
    return panel.cache(), table.cache()


def accuracy(model, panel, table):
    return model.predict(panel, table).join(table, "sample_id").agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]


def test_perceptron_learns_what_a_linear_head_cannot(spark, planted, tmp_path):
    panel, table = planted
    train, test = table.where("sample_id < 200"), table.where("sample_id >= 200")
    settings = {"numeric": ("size",), "categorical": ("kind",), "max_iter": 80}
    deep, flat = MixedModel("mlp", hidden=(8,), **settings).fit(panel, train), MixedModel("linear", **settings).fit(panel, train)
    assert accuracy(deep, panel, test) > 0.85 > 0.75 > accuracy(flat, panel, test)
    deep.save(f"file://{tmp_path}/m")
    again = MixedModel.load(f"file://{tmp_path}/m")
    same = lambda m: sorted((r.sample_id, r.pred, round(r.prob, 9)) for r in m.predict(panel, test).collect())
    assert same(again) == same(deep) and again.names == deep.names
    odd = test.select("sample_id", F.lit(None).cast("double").alias("size"), F.lit("never seen").alias("kind"), "label")
    assert deep.predict(panel, odd).where("pred IN (0, 1)").count() == 100
    with pytest.raises(ValueError):
        deep.importances()


def test_forests_name_what_they_look_at(planted):
    panel, table = planted
    forest = MixedModel("forest", numeric=("size",), categorical=("kind",), trees=40, depth=8).fit(panel, table.where("sample_id < 200"))
    assert accuracy(forest, panel, table.where("sample_id >= 200")) > 0.7
    top = [r.source for r in forest.importances().limit(6).collect()]
    assert any(n.startswith("kind=") for n in top) and any(n.startswith("var0__") for n in top) and len(forest.names) == 2 * 15 + 1 + 4
    target = table.select("sample_id", "kind", "size", F.when(F.col("kind") == "a", 5.0).otherwise(1.0).alias("label"))
    boosted = MixedModel("boosted", "value", numeric=("size",), categorical=("kind",), trees=5, depth=3).fit(None, target)
    assert boosted.importances().first().source.startswith("kind=")
    off = boosted.predict(None, target).join(target, "sample_id").agg(F.max(F.abs(F.col("pred") - F.col("label")))).first()[0]
    assert off < 0.1
    with pytest.raises(ValueError):
        MixedModel("mlp", "value")


def test_steps_of_a_head_have_few_tasks(spark, planted):
    """Each step of a fit reads as many pieces as the features' bytes need, however many partitions made them."""
    panel, table = planted
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("heads", "steps of a head")
    try:
        MixedModel("mlp", hidden=(4,), numeric=("size",), categorical=("kind",), max_iter=3).fit(panel, table)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("heads") for s in tracker.getJobInfo(j).stageIds]
    steps = [s.numTasks for s in stages if s and "LBFGS" in s.name]
    assert steps and max(steps) < 16


class Stub:
    def __init__(self, value=0):
        self.value = value

    def save(self, path):
        name = path.removeprefix("file://")
        import os

        os.makedirs(name)
        with open(f"{name}/value", "w") as f:
            f.write(str(self.value))

    @classmethod
    def load(cls, path):
        with open(path.removeprefix("file://") + "/value") as f:
            return cls(int(f.read()))


def test_concurrent_savers_leave_one_best(spark, tmp_path):
    store.register("stub", Stub)
    models = store.ModelStore(f"file://{tmp_path}/models")
    assert models.versions("m") == [] and models.best("m", "loss", "min") is None
    run = [threading.Thread(target=models.save, args=("m", Stub(i), {"loss": float((i * 7) % 10)})) for i in range(10)]
    for t in run:
        t.start()
    for t in run:
        t.join()
    assert len(models.versions("m")) == 10 and models.load("m", metric="loss", when="min").value == 0 and models.load("m", metric="loss").value == 7
    assert models.save("m", Stub(11), {"loss": 0.0}, "min", "loss") is None and models.save("m", Stub(12), {"loss": float("nan")}, "min", "loss") is None
    newest = models.save("m", Stub(13), {"loss": -1.0}, "min", "loss")
    assert models.best("m", "loss", "min")["version"] == newest and models.load("m").value == 13 and models.load("m", newest).value == 13
    (tmp_path / "models/m/99-half/model").mkdir(parents=True)  # a save that was lost before its metadata
    assert models.load("m").value == 13 and models.table(spark, "m", "other").count() == 11
    assert isinstance(store.create("stub", value=3), Stub)
    with pytest.raises(KeyError):
        models.load("other")
    with pytest.raises(KeyError):
        store.create("nothing")
    with pytest.raises(ValueError):
        store.register("stub", dict)


def test_clipped_gradients(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.3, 0.4]), (3, []), (4, [-2.0, 0.5])], "id int, gradient array<double>")
    by_norm = {r.id: r for r in dynamics.clipped_gradients(rows, 1.0).collect()}
    assert np.allclose(by_norm[1].gradient, [0.6, 0.8]) and by_norm[2].gradient == [0.3, 0.4] and by_norm[3].gradient == [] and by_norm[1].norm == 5
    by_value = {r.id: r.gradient for r in dynamics.clipped_gradients(rows, 1.0, "value").collect()}
    assert by_value == {1: [1.0, 1.0], 2: [0.3, 0.4], 3: [], 4: [-1.0, 0.5]}
    s = dynamics.clip_statistics(dynamics.clipped_gradients(rows, 1.0)).first()
    assert (s.batches, s.n_clipped, s.share, s.max_norm) == (4, 2, 0.5, 5.0)
