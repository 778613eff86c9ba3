"""Heads beyond the linear one: multilayer perceptrons and tree ensembles over series features and tabular columns.

An ``ml.Pipeline`` fills and encodes the columns, joins them to the series features and fits the head, all on the
executors. A category that training didn't have gets a slot of its own (as null does), a missing number the
mean of its column.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import features as S
from panelwright.operators.training import _Facade
from panelwright.session import stored

CLASSIFIERS, REGRESSORS = ("mlp", "linear", "forest", "boosted"), ("linear", "forest", "boosted")


class MixedModel(_Facade):
    """``task`` class or value; ``head`` mlp (classes only), linear, forest or boosted (two classes only); the other settings as in ``_Facade``."""

    def __init__(self, head: str = "mlp", task: str = "class", numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = (), hidden: tuple[int, ...] = (16,), trees: int = 30, depth: int = 5, **series):
        if head not in (CLASSIFIERS if task == "class" else REGRESSORS):
            raise ValueError(f"no head {head} for task {task}")
        super().__init__(**{"kind": "statistics", **series})
        self.head, self.task, self.numeric, self.categorical = head, task, tuple(numeric), tuple(categorical)
        self.hidden, self.trees, self.depth, self.with_series, self.n_vars = tuple(hidden), trees, depth, True, 1

    def _columns(self, panel: DataFrame | None, table: DataFrame, *more: str) -> DataFrame:
        """A row a sample of ``table`` with its columns and, with a panel, its series features."""
        kept = table.select("sample_id", *[F.col(c).cast("double").alias(c) for c in self.numeric], *[F.col(c).cast("string").alias(c) for c in self.categorical], *more)
        return kept.join(self._features(panel), "sample_id") if self.with_series else kept

    def _prepared(self) -> Pipeline:
        stages, parts = [], ["raw"] if self.with_series else []
        if self.numeric:
            stages.append(Imputer(inputCols=list(self.numeric), outputCols=[f"{c}__filled" for c in self.numeric]))
            parts += [f"{c}__filled" for c in self.numeric]
        if self.categorical:
            stages.append(StringIndexer(inputCols=list(self.categorical), outputCols=[f"{c}__index" for c in self.categorical], handleInvalid="keep"))
            stages.append(OneHotEncoder(inputCols=[f"{c}__index" for c in self.categorical], outputCols=[f"{c}__is" for c in self.categorical], handleInvalid="keep", dropLast=False))
            parts += [f"{c}__is" for c in self.categorical]
        stages.append(VectorAssembler(inputCols=parts, outputCol="joined"))
        if self.head in ("mlp", "linear"):
            stages.append(StandardScaler(inputCol="joined", outputCol="features", withMean=True))
        return Pipeline(stages=stages)

    def _head_of(self, width: int, classes: int):
        shared = {"featuresCol": "features" if self.head in ("mlp", "linear") else "joined", "labelCol": "label"}
        if self.head == "mlp":
            return MultilayerPerceptronClassifier(layers=[width, *self.hidden, classes], maxIter=self.max_iter, seed=self.seed, **shared)
        if self.head == "linear":
            return (LogisticRegression if self.task == "class" else LinearRegression)(maxIter=self.max_iter, regParam=self.reg, **shared)
        trees = {"maxDepth": self.depth, "seed": self.seed, **shared}
        if self.head == "forest":
            return (RandomForestClassifier if self.task == "class" else RandomForestRegressor)(numTrees=self.trees, **trees)
        return (GBTClassifier if self.task == "class" else GBTRegressor)(maxIter=self.trees, **trees)

    def fit(self, panel: DataFrame | None, table: DataFrame):
        """``table``: (sample_id, label, columns); rows with a null label take no part. Without a panel the columns alone count."""
        self.with_series = panel is not None
        if self.with_series:
            self.length, last = panel.agg(F.max(F.size("x")), F.max("var_id")).first()
            self.n_vars = last + 1
            self._kernels(panel)
        rows = table.where("label IS NOT NULL").withColumn("label", F.col("label").cast("double"))
        data = stored(self._columns(panel, rows, "label"), "features")
        prepared = self._prepared().fit(data)
        made = prepared.transform(data)
        width = made.select("joined").first()[0].size
        classes = int(data.agg(F.max("label")).first()[0]) + 1 if self.task == "class" else 1
        self.names = self._slots(made.schema["joined"].metadata, width)
        self.model = PipelineModel([*prepared.stages, self._head_of(width, classes).fit(made)])
        return self

    def _slots(self, metadata: dict, width: int) -> list[str]:
        """What each place of the joined vector stands for: var<k>__<feature>, a numeric column, or column=category."""
        known = {a["idx"]: a.get("name", "") for group in metadata.get("ml_attr", {}).get("attrs", {}).values() for a in group}
        others = len(self.numeric) + sum(1 for i, n in known.items() if "__is_" in n)
        series = width - others if self.with_series else 0
        each = max(1, series // self.n_vars)
        label = lambda i: S.SETS["efficient"][i] if self.kind == "statistics" else f"feature{i}"
        rest = [known.get(i, "").replace("__filled", "").replace("__is_", "=") for i in range(series, width)]
        return [f"var{i // each}__{label(i % each)}" for i in range(series)] + rest

    def predict(self, panel: DataFrame | None, table: DataFrame) -> DataFrame:
        """(sample_id, pred) and for classes probs and prob."""
        p = self.model.transform(self._columns(panel, table))
        if self.task != "class":
            return p.select("sample_id", F.col("prediction").alias("pred"))
        return p.select("sample_id", F.col("prediction").cast("int").alias("pred"), vector_to_array("probability").alias("probs")).withColumn("prob", F.array_max("probs"))

    def importances(self) -> DataFrame:
        """(source, importance) of a tree ensemble, the most important first; sources as the series' variables and features, columns and categories."""
        if self.head not in ("forest", "boosted"):
            raise ValueError("only tree ensembles have importances")
        found = self.model.stages[-1].featureImportances.toArray()
        rows = [(n, float(v)) for n, v in zip(self.names, found, strict=True)]
        return SparkSession.getActiveSession().createDataFrame(rows, "source string, importance double").orderBy(F.desc("importance"), "source")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        own = ("head", "task", "numeric", "categorical", "hidden", "trees", "depth", "kind", "seed", "reg", "max_iter")
        state = {"settings": {k: getattr(self, k) for k in own} | {"n_kernels": self.n}, "state": {k: getattr(self, k) for k in ("length", "n_vars", "with_series", "names")}}
        state["bank"] = [(w.tolist(), b, d, p) for w, b, d, p in self.bank]
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("error").text(f"{path}/settings")
        self.model.write().save(f"{path}/pipeline")

    @classmethod
    def load(cls, path: str):
        import numpy as np

        state = json.loads(SparkSession.getActiveSession().read.text(f"{path}/settings").first()[0])
        out = cls(**state["settings"])
        for k, v in state["state"].items():
            setattr(out, k, v)
        out.bank = [(np.array(w), b, d, p) for w, b, d, p in state["bank"]]
        out.model = PipelineModel.load(f"{path}/pipeline")
        return out
