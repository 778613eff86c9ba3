"""Random convolution kernels: features of series for a linear head.

A kernel bank is a function of a seed, some kilobytes, and goes to the tasks with the function; each Arrow
batch of series is convolved at once in NumPy. Series of one call must have one length a batch row may
differ from: shorter ones are handled row by row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rocket_bank(n: int, seq_len: int, seed: int = 42, lengths: tuple[int, ...] = (7, 9, 11)) -> list[tuple[np.ndarray, float, int, int]]:
    """(weights centred on their mean, bias in -1 ... 1, dilation, padding)."""
    rng, bank = np.random.default_rng(seed), []
    for _ in range(n):
        k = int(rng.choice([v for v in lengths if v <= seq_len] or [min(seq_len, lengths[0])]))
        w = rng.normal(size=k)
        dilation = int(2 ** rng.uniform(0, np.log2(max((seq_len - 1) / max(k - 1, 1), 1))))
        bank.append((w - w.mean(), float(rng.uniform(-1, 1)), dilation, (k - 1) * dilation // 2 if rng.random() < 0.5 else 0))
    return bank


def minirocket_bank(n: int, seq_len: int, seed: int = 42) -> list[tuple[np.ndarray, float, int, int]]:
    """Nine taps of -1 with three of 2, all 84 ways, in rounds with a random dilation each."""
    rng, bank = np.random.default_rng(seed), []
    while len(bank) < n:
        dilation = int(rng.integers(1, max((seq_len - 1) // 8, 1) + 1))
        for at in combinations(range(9), 3):
            w = np.full(9, -1.0)
            w[list(at)] = 2.0
            bank.append((w, float(rng.uniform(-1, 1)), dilation, 0))
    return bank[:n]


def convolve(x: np.ndarray, w: np.ndarray, dilation: int, padding: int) -> np.ndarray:
    """Rows of ``x`` with a dilated kernel; no columns where the kernel is longer than the series."""
    if padding:
        x = np.pad(x, ((0, 0), (padding, padding)))
    n = x.shape[1] - (len(w) - 1) * dilation
    if n <= 0:
        return np.zeros((len(x), 0))
    return sum(v * x[:, i * dilation : i * dilation + n] for i, v in enumerate(w))


def _longest_run(on: np.ndarray) -> np.ndarray:
    run = best = np.zeros(len(on))
    for column in on.T:
        run = np.where(column, run + 1, 0)
        best = np.maximum(best, run)
    return best


def pool(y: np.ndarray, bias: float, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """max, ppv (share above the bias), mpv (mean above it), mipv (mean place of those, 0.5 without any), lspv (longest run of them, as a share)."""
    rows, n = y.shape
    if not n:
        return [np.full(rows, 0.5 if k == "mipv" else 0.0) for k in kinds]
    on = y > bias
    count = np.maximum(on.sum(axis=1), 1)
    made = {
        "max": lambda: y.max(axis=1), "ppv": lambda: on.mean(axis=1), "mpv": lambda: np.where(on, y, 0).sum(axis=1) / count,
        "mipv": lambda: np.where(on.any(axis=1), (on * (np.arange(n) / n)).sum(axis=1) / count, 0.5), "lspv": lambda: _longest_run(on) / n,
    }
    return [made[k]() for k in kinds]


#: Fixed sets of what is pooled from a kernel's output.
KINDS = {"rocket": ("max", "ppv"), "minirocket": ("ppv",), "multirocket": ("ppv", "mpv", "mipv", "lspv")}


def fitted_biases(series: list[np.ndarray], bank: list) -> list:
    """The bank with each bias set to the median output over ``series``; a kernel without any output keeps its own."""
    def median(w, bias, d, p):
        y = [convolve(x[None], w, d, p).ravel() for x in series]
        y = np.concatenate(y) if y else np.zeros(0)
        return float(np.median(y)) if y.size else bias

    return [(w, median(w, b, d, p), d, p) for w, b, d, p in bank]


def fit_bank(panel: DataFrame, bank: list, rows: int = 100) -> list:
    """``bank`` with biases fitted to the first ``rows`` series by id; that bounds what reaches the driver."""
    few = panel.orderBy("sample_id", "var_id").select("x").limit(rows).collect()
    return fitted_biases([np.array(r.x, float) for r in few], bank)


def extract_array(x: np.ndarray, bank: list, kinds: tuple[str, ...]) -> np.ndarray:
    return np.stack([f for w, b, d, p in bank for f in pool(convolve(x, w, d, p), b, kinds)], axis=1)


def extract(panel: DataFrame, bank: list, kind: str = "rocket") -> DataFrame:
    """(sample_id, var_id, features) of the panel's series."""
    import pandas as pd

    kinds = KINDS[kind]

    def run(batches):
        for b in batches:
            size = b["x"].map(len)
            for _, part in b.groupby(size):
                out = extract_array(np.stack(part["x"].to_numpy()), bank, kinds)
                yield pd.DataFrame({"sample_id": part["sample_id"], "var_id": part["var_id"], "features": list(out)})

    return panel.select(F.col("sample_id").cast("long"), F.col("var_id").cast("int"), "x").mapInPandas(run, "sample_id long, var_id int, features array<double>")


def hydra_groups(n_groups: int, kernels: int, seed: int = 42, size: int = 9) -> list[np.ndarray]:
    """Groups of centred uniform kernels; group g has dilation 2^g."""
    rng = np.random.default_rng(seed)
    banks = [rng.uniform(-1, 1, size=(kernels, size)) for _ in range(n_groups)]
    return [b - b.mean(axis=1, keepdims=True) for b in banks]


def hydra(panel: DataFrame, groups: list[np.ndarray]) -> DataFrame:
    """(sample_id, var_id, features): max, mean and share above 0 of each kernel's output."""
    bank = [(w, 0.0, 2**g, 0) for g, b in enumerate(groups) for w in b]
    import pandas as pd

    def run(batches):
        for b in batches:
            for _, part in b.groupby(b["x"].map(len)):
                x = np.stack(part["x"].to_numpy())
                outs = [convolve(x, w, d, p) for w, _, d, p in bank]
                f = [v for y in outs for v in ((y.max(axis=1), y.mean(axis=1), (y > 0).mean(axis=1)) if y.shape[1] else [np.zeros(len(x))] * 3)]
                yield pd.DataFrame({"sample_id": part["sample_id"], "var_id": part["var_id"], "features": list(np.stack(f, axis=1))})

    return panel.select(F.col("sample_id").cast("long"), F.col("var_id").cast("int"), "x").mapInPandas(run, "sample_id long, var_id int, features array<double>")


def hydra_multirocket(panel: DataFrame, groups: list[np.ndarray]) -> DataFrame:
    """(sample_id, var_id, features): MultiRocket's four features of each Hydra kernel; a kernel longer than the series gives zeros."""
    bank = [(w, 0.0, 2**g, 0) for g, b in enumerate(groups) for w in b]
    longest = max(((len(w) - 1) * d + 1 for w, _, d, _ in bank), default=0)
    out = extract(panel, bank, "multirocket")
    if not bank:
        return out
    needs = F.array(*[F.lit((len(w) - 1) * d + 1) for w, _, d, _ in bank])
    sizes = panel.select(F.col("sample_id").alias("_s"), F.col("var_id").alias("_v"), F.size("x").alias("_n")).where(F.col("_n") < longest)
    j = out.join(sizes, (F.col("sample_id") == F.col("_s")) & (F.col("var_id") == F.col("_v")), "left")
    zeroed = F.transform("features", lambda v, i: F.when(F.get(needs, F.floor(i / 4).cast("int")) > F.col("_n"), 0.0).otherwise(v))
    return j.select("sample_id", "var_id", F.when(F.col("_n").isNull(), F.col("features")).otherwise(zeroed).alias("features"))
