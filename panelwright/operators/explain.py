"""Importance and attribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import arrays as A
from panelwright.functions import rand as R
from panelwright.operators.splits import global_rank


def permuted(df: DataFrame, column: str, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """``df`` with ``column`` taken from the next row of a shuffled ring."""
    ranked = global_rank(df.select(id_col, column), R.bits(seed, f"permute:{column}", id_col), id_col)
    n = df.count()
    other = ranked.select(((F.col("rank") - 1 + n) % n).alias("_k"), F.col(column).alias("_v")) if n else ranked.select(F.col("rank").alias("_k"), F.col(column).alias("_v"))
    pairs = ranked.join(other, F.col("rank") == F.col("_k")).select(F.col(id_col).alias("_id"), "_v")
    return df.join(pairs, df[id_col] == F.col("_id")).withColumn(column, F.col("_v")).drop("_id", "_v")


def _importance(score: Callable[[DataFrame], float], base: float, shuffled: list[DataFrame]) -> tuple[float, float]:
    """Mean and population deviation of the loss of score."""
    lost = np.array([base - score(df) for df in shuffled])
    return float(lost.mean()), float(lost.std())


def permutation_importance(df: DataFrame, columns: list[str], score: Callable[[DataFrame], float], seed: int = 42, repeats: int = 5) -> list[tuple[str, float, float]]:
    """(column, mean, deviation) of the loss of score over ``repeats`` shuffles of each column, the most important first."""
    base = score(df)
    found = [(c, *_importance(score, base, [permuted(df, c, seed + i) for i in range(repeats)])) for c in columns]
    return sorted(found, key=lambda t: (-t[1], t[0]))


def step_importance(df: DataFrame, steps: list[int], score: Callable[[DataFrame], float], seed: int = 42, repeats: int = 5, id_col: str = "sample_id") -> list[tuple[int, float, float]]:
    """As permutation_importance for single steps of the series ``x`` (a row a sample): step t is taken from the next row of a shuffled ring."""

    def moved(t: int, s: int) -> DataFrame:
        one = permuted(df.withColumn("_step", F.get("x", F.lit(t))), "_step", s, id_col)
        return one.withColumn("x", F.transform("x", lambda v, i: F.when(i == t, F.col("_step")).otherwise(v))).drop("_step")

    base = score(df)
    found = [(t, *_importance(score, base, [moved(t, seed + i) for i in range(repeats)])) for t in steps]
    return sorted(found, key=lambda t: (-t[1], t[0]))


def input_x_gradient(x: Column | str, gradient: Column | str) -> Column:
    """|x g| of two arrays."""
    return F.zip_with(A.col(x), A.col(gradient), lambda a, b: F.abs(a * b))


def zero_baseline(x: Column | str) -> Column:
    return F.transform(A.col(x), lambda v: F.lit(0.0))


def normal_baseline(x: Column | str, seed: int = 42, keys: tuple[str, ...] = ("sample_id", "var_id")) -> Column:
    """Standard normal values in the shape of ``x``, the same on every run."""
    return F.transform(A.col(x), lambda v, t: R.normal(seed, "baseline", *keys, t))


def normalised(attributions: DataFrame, by: list[str], column: str = "attribution") -> DataFrame:
    """Arrays scaled to 0 ... 1 by the least and greatest value of each group of ``by``; constant groups become 0."""
    ends = attributions.groupBy(*by).agg(F.min(F.array_min(column)).alias("_lo"), F.max(F.array_max(column)).alias("_hi"))
    j = attributions.join(ends, by)
    scale = F.col("_hi") - F.col("_lo")
    return j.withColumn(column, F.transform(column, lambda v: F.when(scale > 0, (v - F.col("_lo")) / scale).otherwise(0.0))).drop("_lo", "_hi")


def mean_by_variable(attributions: DataFrame, column: str = "attribution") -> DataFrame:
    """(var_id, mean) over samples and steps."""
    return attributions.select("var_id", F.explode(column).alias("v")).groupBy("var_id").agg(F.avg("v").alias("mean"))


def mean_by_step(attributions: DataFrame, column: str = "attribution") -> DataFrame:
    """(t, mean) over samples and variables."""
    return attributions.select(F.posexplode(column).alias("t", "v")).groupBy("t").agg(F.avg("v").alias("mean"))


def grad_cam(activations: Column | str, gradients: Column | str) -> Column:
    """relu(sum over channels of mean gradient x activation), scaled to a maximum of 1; both are arrays (channel, step)."""
    a, g = A.col(activations), A.col(gradients)
    w = F.transform(g, lambda row: A.total(row) / F.size(row))
    steps = A.steps(F.size(F.get(a, F.lit(0))))
    cam = A.let(w, lambda w: F.transform(steps, lambda t: F.greatest(A.total(F.zip_with(a, w, lambda row, k: F.get(row, t) * k)), F.lit(0.0))))
    return A.let(cam, lambda c: A.let(F.array_max(c), lambda m: F.transform(c, lambda v: F.when(m > 0, v / m).otherwise(0.0))))


def integrated_gradients(x: np.ndarray, baseline: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int = 50) -> np.ndarray:
    """Absolute values of (x - baseline) times the mean gradient along the straight line between them, by the trapezoid rule."""
    found = np.array([gradient(baseline + p * (x - baseline)) for p in np.linspace(0, 1, steps + 1)])
    return np.abs((x - baseline) * ((found[1:] + found[:-1]) / 2).mean(axis=0))


def attention_mean(layers: list[np.ndarray]) -> np.ndarray:
    """Mean over layers and heads, summed over the query positions: one value a key."""
    return np.mean([a.mean(axis=0) for a in layers], axis=0).sum(axis=0)


def attention_last(layers: list[np.ndarray]) -> np.ndarray:
    """Head mean of the last layer, summed over the query positions."""
    return layers[-1].mean(axis=0).sum(axis=0)


def attention_rollout(layers: list[np.ndarray]) -> np.ndarray:
    """Product over layers of (head mean + identity) / 2, rows summing to 1."""
    out = None
    for a in layers:
        m = a.mean(axis=0) + np.eye(a.shape[-1])
        m = m / m.sum(axis=-1, keepdims=True)
        out = m if out is None else m @ out
    return out


def integrated_over_rows(rows: DataFrame, gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], target: str = "pred", baseline: str | None = None, steps: int = 50, signed: bool = True) -> DataFrame:
    """Adds ``attribution``, an array as long as ``features``: the path integral of ``gradient`` from a baseline to each row.

    ``gradient``: (matrix of rows, targets) -> matrix; ``baseline``: an array column, zeros without one. All rows of a
    batch go one step of the path at a time, so no row is ever exploded. Signed attributions of a row add up to
    the difference of the scores, but for the error of the trapezoid rule; else they are absolute. Null features give null.
    """
    kept = [c for c in rows.columns if c != "attribution"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("features").is_valid()
            part = batch.filter(known)
            lengths = part.column("features").value_lengths().to_numpy(zero_copy_only=False)
            out: list = [None] * batch.num_rows
            places = np.nonzero(known.to_numpy(zero_copy_only=False))[0]
            for n in np.unique(lengths):
                some = np.nonzero(lengths == n)[0]
                x = np.stack([np.asarray(part.column("features")[i].as_py(), float) for i in some])
                start = np.zeros_like(x) if baseline is None else np.stack([np.asarray(part.column(baseline)[i].as_py(), float) for i in some])
                aim = part.column(target).to_numpy(zero_copy_only=False)[some].astype(int)
                total = np.zeros_like(x)
                for k in range(steps + 1):
                    total += gradient(start + k / steps * (x - start), aim) * (0.5 if k in (0, steps) else 1.0)
                found = (x - start) * total / steps
                for i, row in zip(some, found if signed else np.abs(found), strict=True):
                    out[places[i]] = row.tolist()
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"attribution": pa.array(out, pa.list_(pa.float64()))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.select(*kept).mapInArrow(run, f"{kinds}, attribution array<double>")


#: Ways to make one value a key of the attention of all layers.
ATTENTION = {"mean": attention_mean, "last": attention_last, "rollout": lambda layers: attention_rollout(layers).sum(axis=0)}


def attention_over_rows(rows: DataFrame, how: str = "mean", column: str = "attention") -> DataFrame:
    """Adds ``attribution``, a value a key, from an array column (layer, head, query, key); a row at a time, null for null."""
    combine, kept = ATTENTION[how], [c for c in rows.columns if c != "attribution"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if a is None else combine([np.asarray(layer, float) for layer in a]).tolist() for a in (v.as_py() for v in batch.column(column))]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"attribution": pa.array(found, pa.list_(pa.float64()))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.select(*kept).mapInArrow(run, f"{kinds}, attribution array<double>")
