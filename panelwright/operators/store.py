"""A store of fitted models: versions by name with their metrics, and constructors by name.

A version is a folder that nothing else writes to; its metadata are moved into place last, so a version without them doesn't
exist for readers. Which version is best is read from the metadata of all of them, so savers need no lock
and no pointer that two of them could set: whoever saves, all readers agree.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelwright.operators.heads import MixedModel
from panelwright.operators.training import SeriesClassifier, SeriesRegressor
from panelwright.sources.npy import open_path

#: Constructors by name: classes with ``save`` and ``load``.
MODELS: dict[str, type] = {"series_classifier": SeriesClassifier, "series_regressor": SeriesRegressor, "mixed": MixedModel}
VERSIONS = "name string, version string, model string, saved double, metrics map<string,double>"


def register(name: str, model: type) -> None:
    """Make a class with ``save`` and ``load`` known; a name can't be taken twice."""
    if MODELS.setdefault(name, model) is not model:
        raise ValueError(f"{name} is taken")


def create(name: str, **settings):
    """A new model by the name of its constructor."""
    if name not in MODELS:
        raise KeyError(f"no model {name}; known are {', '.join(sorted(MODELS))}")
    return MODELS[name](**settings)


class ModelStore:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def save(self, name: str, model, metrics: dict[str, float], when: str = "every", metric: str | None = None) -> str | None:
        """The new version, or None where ``when`` is min or max and ``metric`` is no better than that of the best version."""
        if when not in ("every", "min", "max") or when != "every" and metric not in metrics:
            raise ValueError("when is every, or min or max with a metric that is given")
        if when != "every":
            best = self.best(name, metric, when)
            new, old = metrics[metric], best and best["metrics"][metric]
            if math.isnan(new) or best and (new >= old if when == "min" else new <= old):
                return None
        kind = next((k for k, c in MODELS.items() if type(model) is c), None)
        if kind is None:
            raise ValueError("the model's class is not registered")
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        model.save(f"{self.path}/{name}/{version}/model")
        store, folder = open_path(f"{self.path}/{name}/{version}")
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_metadata") as f:
            f.write(json.dumps({"name": name, "version": version, "model": kind, "saved": time.time(), "metrics": metrics}).encode())
        store.move(f"{folder}/_metadata", f"{folder}/metadata.json")
        return version

    def versions(self, name: str) -> list[dict]:
        """Metadata of the versions that are whole, oldest first; a few, a version each."""
        from pyarrow import fs

        store, folder = open_path(f"{self.path}/{name}")
        out = []
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            file = f"{info.path}/metadata.json"
            if store.get_file_info(file).type == fs.FileType.File:
                with store.open_input_stream(file) as f:
                    out.append(json.loads(f.read()))
        return sorted(out, key=lambda m: m["version"])

    def best(self, name: str, metric: str, when: str = "max") -> dict | None:
        """Metadata of the version of least or greatest ``metric``; NaN never is, and of equal ones the oldest."""
        known = [m for m in self.versions(name) if not math.isnan(m["metrics"].get(metric, math.nan))]
        sign = 1 if when == "min" else -1
        return min(known, key=lambda m: (sign * m["metrics"][metric], m["version"]), default=None)

    def load(self, name: str, version: str | None = None, metric: str | None = None, when: str = "max"):
        """A version, the best by ``metric``, or the newest."""
        known = self.versions(name)
        found = next((m for m in known if m["version"] == version), None) if version else self.best(name, metric, when) if metric else known[-1] if known else None
        if found is None:
            raise KeyError(f"no such version of {name}")
        return MODELS[found["model"]].load(f"{self.path}/{name}/{found['version']}/model")

    def table(self, spark: SparkSession, *names: str) -> DataFrame:
        """The versions as rows."""
        return spark.createDataFrame([(m["name"], m["version"], m["model"], m["saved"], m["metrics"]) for n in names for m in self.versions(n)], VERSIONS)
