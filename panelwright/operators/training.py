"""Classifier, regressor and forecaster: kernel or statistical features with a pyspark.ml head, or a linear map of windows."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import features as S
from panelwright.operators import metrics, rocket, windows
from panelwright.session import stored

BANKS = {
    "minirocket": lambda n, length, seed: rocket.minirocket_bank(n, length, seed),
    "rocket": lambda n, length, seed: rocket.rocket_bank(n, length, seed),
    "multirocket": lambda n, length, seed: rocket.minirocket_bank(n, length, seed),
}
#: Kernels of a Hydra group; the groups' dilations are powers of two.
HYDRA_SIZE = 8


class _Facade:
    """``kind``: statistics, minirocket, rocket, multirocket, hydra or hydra_multirocket."""

    model_class: type

    def __init__(self, kind: str = "minirocket", n_kernels: int = 252, seed: int = 42, reg: float = 0.01, max_iter: int = 50):
        self.kind, self.n, self.seed, self.reg, self.max_iter = kind, n_kernels, seed, reg, max_iter
        self.length, self.bank = 0, []

    def _kernels(self, panel: DataFrame) -> None:
        """The kernel bank for the longest series; Rocket's biases are medians over the first series."""
        if self.kind in BANKS:
            self.bank = BANKS[self.kind](self.n, self.length, self.seed)
            if self.kind != "minirocket":
                self.bank = rocket.fit_bank(panel, self.bank)

    def _groups(self) -> list[np.ndarray]:
        return rocket.hydra_groups(max(1, self.n // HYDRA_SIZE), HYDRA_SIZE, self.seed)

    def _features(self, panel: DataFrame) -> DataFrame:
        """A vector a sample: its variables' features joined in order."""
        panel = panel.select("sample_id", "var_id", "x")
        if self.kind == "statistics":
            names = S.SETS["efficient"]
            each = S.features(panel, "efficient")
            each = each.select("sample_id", "var_id", F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).alias("features"))
        elif self.kind == "hydra":
            each = rocket.hydra(panel, self._groups())
        elif self.kind == "hydra_multirocket":
            each = rocket.hydra_multirocket(panel, self._groups())
        else:
            each = rocket.extract(panel, self.bank, self.kind)
        together = each.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("var_id", "features"))).alias("v"))
        return together.select("sample_id", array_to_vector(F.flatten(F.transform("v", lambda s: s["features"]))).alias("raw"))

    def _head(self):
        raise NotImplementedError

    def fit(self, panel: DataFrame, labels: DataFrame):
        """``labels``: (sample_id, label). Features are computed once and stored, since the head reads them in each of its steps."""
        self.length = panel.agg(F.max(F.size("x"))).first()[0] or 0
        self._kernels(panel)
        data = self._features(panel).join(labels.select("sample_id", F.col("label").cast("double").alias("label")), "sample_id")
        data = stored(data, "features")
        self.scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data)
        self.model = self._head().fit(self.scaler.transform(data))
        return self

    def _predicted(self, panel: DataFrame) -> DataFrame:
        return self.model.transform(self.scaler.transform(self._features(panel)))

    def save(self, path: str) -> None:
        """Settings with the kernel bank as JSON, the scaler and the head, in folders under ``path``."""
        spark = SparkSession.getActiveSession()
        bank = [(w.tolist(), b, d, p) for w, b, d, p in self.bank]
        settings = {"kind": self.kind, "n_kernels": self.n, "seed": self.seed, "reg": self.reg, "max_iter": self.max_iter, "length": self.length, "bank": bank}
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("error").text(f"{path}/settings")
        self.scaler.save(f"{path}/scaler")
        self.model.save(f"{path}/head")

    @classmethod
    def load(cls, path: str):
        spark = SparkSession.getActiveSession()
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        bank, length = settings.pop("bank"), settings.pop("length")
        out = cls(**settings)
        out.bank, out.length = [(np.array(w), b, d, p) for w, b, d, p in bank], length
        out.scaler, out.model = StandardScalerModel.load(f"{path}/scaler"), cls.model_class.load(f"{path}/head")
        return out


class SeriesClassifier(_Facade):
    model_class = LogisticRegressionModel

    def _head(self):
        return LogisticRegression(maxIter=self.max_iter, regParam=self.reg)

    def predict(self, panel: DataFrame) -> DataFrame:
        """(sample_id, pred, probs, prob)."""
        p = self._predicted(panel).select("sample_id", F.col("prediction").cast("int").alias("pred"), vector_to_array("probability").alias("probs"))
        return p.withColumn("prob", F.array_max("probs"))

    def evaluate(self, panel: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Predictions with their labels, and one row of metrics."""
        p = self.predict(panel).join(labels.select("sample_id", "label"), "sample_id")
        return p, metrics.evaluate(p)


class SeriesRegressor(_Facade):
    model_class = LinearRegressionModel

    def _head(self):
        return LinearRegression(maxIter=self.max_iter, regParam=self.reg)

    def predict(self, panel: DataFrame) -> DataFrame:
        return self._predicted(panel).select("sample_id", F.col("prediction").alias("pred"))

    def evaluate(self, panel: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = self.predict(panel).join(labels.select("sample_id", F.col("label").alias("target")), "sample_id")
        return p, metrics.regression(p)


class SeriesForecaster:
    """Ridge regression of the next ``horizon`` values on the last ``window``, for all steps at once.

    The sums of products of all windows are made by Arrow batch and added up by Spark, a table of
    (window + 1) x (window + 1 + horizon) numbers whatever the number of series; the driver solves it.
    """

    def __init__(self, window: int, horizon: int, reg: float = 1e-3):
        self.window, self.horizon, self.reg = window, horizon, reg

    def fit(self, panel: DataFrame, stride: int = 1):
        """On every window of the panel's series (sample_id, var_id, x)."""
        rows = windows.forecast_windows(panel.select("sample_id", "var_id", "x"), self.window, self.horizon, stride)
        return self.fit_targets(rows.select(F.col("window").alias("x"), F.col("target").alias("y")))

    def fit_targets(self, rows: DataFrame):
        """On rows (x, y); x must have ``window`` and y ``horizon`` values."""
        import pandas as pd

        w, h = self.window, self.horizon
        odd = rows.where((F.size("x") != w) | (F.size("y") != h)).limit(1).collect()
        if odd:
            raise ValueError(f"windows of {w} and targets of {h} values are needed")

        def products(batches):
            total = np.zeros((w + 1, w + 1 + h))
            for b in batches:
                if len(b):
                    x = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_numpy())])
                    total += x.T @ np.column_stack([x, np.stack(b["y"].to_numpy())])
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

        sums = rows.select("x", "y").mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        found = np.zeros((w + 1, w + 1 + h))
        for i, j, v in sums.collect():
            found[i, j] = v
        ridge = self.reg * np.diag([0.0] + [1.0] * w)
        self.weights = np.linalg.lstsq(found[:, : w + 1] + ridge, found[:, w + 1 :], rcond=None)[0]
        return self

    def predict(self, panel: DataFrame) -> DataFrame:
        """(sample_id, var_id, forecast) from the last ``window`` values; shorter series get null."""
        x = F.slice("x", F.size("x") - self.window + 1, F.lit(self.window))
        step = lambda k: F.aggregate(F.zip_with("_x", F.array(*map(F.lit, k[1:])), lambda a, b: a * b), F.lit(float(k[0])), lambda a, v: a + v)
        last = panel.where(F.size("x") >= self.window).select("sample_id", "var_id", x.alias("_x"))
        made = last.select("sample_id", "var_id", F.array(*[step([float(v) for v in self.weights[:, k]]) for k in range(self.horizon)]).alias("forecast"))
        short = panel.where(F.size("x") < self.window).select("sample_id", "var_id", F.lit(None).cast("array<double>").alias("forecast"))
        return made.union(short)
