"""Self-training: a model labels what has no label, and is trained again on both, with noise, for some rounds.

Each round's predictions, and its pseudo-labels with their noise, are written to the shared folder and read back, so
rounds don't pile up in one plan, noise is drawn once however often a fit reads its rows (and by all tasks, however few
files there are), and lost executors cost one round; its statistics are a row each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.rand import normal
from panelwright.operators.dynamics import pseudo_labels
from panelwright.session import scratch

STATISTICS = "round int, labelled long, pseudo long, mean_confidence double, changed double, valid_accuracy double"


def noisy(features: Column | str, scale: float, seed: int, salt: Column) -> Column:
    """Features with normal noise drawn from the row's id, the same wherever the row is."""
    return F.transform(features, lambda v, i: v + scale * normal(seed, "noise", salt, i)) if scale else F.col(features)


@dataclass
class NoisyStudent:
    """``fit(rows, round)`` gives a model with ``predict``; rows have (sample_id, features, label, weight).

    Round 0 is trained on labelled rows alone. Each later round takes the confident predictions on the others (``how`` and
    ``settings`` as ``dynamics.pseudo_labels``), adds noise to their features, and trains on both. It stops after
    ``rounds``, or when fewer than ``least_change`` of the pseudo-labels are new or different.
    """

    fit_model: Callable[[DataFrame, int], object]
    rounds: int = 3
    how: str = "threshold"
    settings: dict = field(default_factory=dict)
    noise: float = 0.1
    least_change: float = 0.0
    seed: int = 42
    statistics: list[tuple] = field(default_factory=list)

    def fit(self, labelled: DataFrame, unlabelled: DataFrame, valid: DataFrame | None = None):
        """The model of the last round. ``labelled``: (sample_id, features, label), null labels left out; ``unlabelled``: (sample_id, features)."""
        spark = labelled.sparkSession
        own = labelled.where("label IS NOT NULL").select("sample_id", "features", F.col("label").cast("int").alias("label"), F.lit(1.0).alias("weight"))
        n, before, self.statistics = own.count(), None, []
        model = self.fit_model(own, 0)
        self.statistics.append((0, n, 0, None, None, self._accuracy(model, valid)))
        for k in range(1, self.rounds + 1):
            guesses, path = scratch(spark, f"guesses-{k}"), scratch(spark, f"pseudo-{k}")
            model.predict(unlabelled.select("sample_id", "features")).select("sample_id", "features", "pred", "prob").write.parquet(guesses)
            sure = pseudo_labels(spark.read.parquet(guesses), self.how, **self.settings)
            sure.repartition("sample_id").select("sample_id", noisy("features", self.noise, self.seed + k, F.col("sample_id")).alias("features"), F.col("pred").alias("label"), "weight").write.parquet(path)
            taken = spark.read.parquet(path)
            found = taken.agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("confidence")).first()
            changed = 1.0 if before is None else taken.join(before.select("sample_id", F.col("label").alias("_was")), "sample_id", "left").agg(F.avg((F.coalesce(F.col("_was") != F.col("label"), F.lit(True))).cast("double"))).first()[0]
            if not found.n or (before is not None and changed <= self.least_change):
                break
            model = self.fit_model(own.unionByName(taken), k)
            self.statistics.append((k, n, found.n, found.confidence, changed, self._accuracy(model, valid)))
            before = taken
        return model

    @staticmethod
    def _accuracy(model, valid: DataFrame | None) -> float | None:
        if valid is None:
            return None
        return model.predict(valid).where("label IS NOT NULL").agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]

    def table(self, spark: SparkSession) -> DataFrame:
        """The statistics of the rounds."""
        return spark.createDataFrame(self.statistics, STATISTICS)
