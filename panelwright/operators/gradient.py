"""Gradient training over a table: parameters go out with each round, sums of gradients come back.

A round is one pass over the rows: each task adds up loss and gradient of its rows by Arrow batch, the tasks' sums are
added up by Spark in a fixed number of slots, and only these (the size of the parameters each) reach the driver, which
takes the optimiser's step. Rows never leave the executors, and what is sent grows with the model, not with the
data; ``MOST_PARAMETERS`` bounds it. Train on a stored or cached table, since each round reads it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PARAMETERS = 4_000_000
#: Sums of gradients that reach the driver in a round.
SLOTS = 16


class Sgd:
    """Steps against the gradient, with momentum."""

    def __init__(self, momentum: float = 0.0, decay: float = 0.0):
        self.momentum, self.decay, self.m = momentum, decay, 0.0

    def step(self, w: np.ndarray, g: np.ndarray, lr: float) -> np.ndarray:
        self.m = self.momentum * self.m + g
        return w - lr * self.m - self.decay * w


class RAdam:
    """Adam whose step is rectified by the variance of its rates, and plain momentum while that has no bound."""

    def __init__(self, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, decay: float = 0.0):
        self.beta1, self.beta2, self.eps, self.decay = beta1, beta2, eps, decay
        self.t, self.m, self.v = 0, 0.0, 0.0

    def step(self, w: np.ndarray, g: np.ndarray, lr: float) -> np.ndarray:
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        m, left = self.m / (1 - self.beta1**self.t), 1 - self.beta2**self.t
        longest = 2 / (1 - self.beta2) - 1
        length = longest - 2 * self.t * (1 - left) / left
        if length > 5:
            rectified = math.sqrt((length - 4) * (length - 2) * longest / ((longest - 4) * (longest - 2) * length))
            m = rectified * m / (np.sqrt(self.v / left) + self.eps)
        return w - lr * m - self.decay * w


class Ranger:
    """RAdam with lookahead: every ``k`` steps slow weights go ``alpha`` of the way to the fast ones, which begin there anew."""

    def __init__(self, k: int = 6, alpha: float = 0.5, **radam):
        self.k, self.alpha, self.inner, self.slow, self.n = k, alpha, RAdam(**radam), None, 0

    def step(self, w: np.ndarray, g: np.ndarray, lr: float) -> np.ndarray:
        fast = self.inner.step(w, g, lr)
        self.slow = fast.copy() if self.slow is None else self.slow
        self.n += 1
        if self.n % self.k:
            return fast
        self.slow = self.slow + self.alpha * (fast - self.slow)
        return self.slow.copy()


def one_cycle(step: int, most: float, total: int, start_share: float = 0.3, div: float = 25.0, final_div: float = 1e4) -> float:
    """``schedules.one_cycle`` of one step, for the driver's loop."""
    s, warm, low, end = min(step, max(total - 1, 0)), int(total * start_share), most / div, most / final_div
    if s < warm:
        return low + (most - low) * s / max(warm, 1)
    return end + (most - end) * (1 + math.cos(math.pi * (s - warm) / (total - warm))) / 2


class Network:
    """Softmax classes (or with ``classes`` 1 a number) over layers of ``hidden`` units with tanh; the parameters lie in one vector."""

    def __init__(self, n_in: int, hidden: tuple[int, ...] = (), classes: int = 2):
        self.sizes, self.classes = (n_in, *hidden, classes), classes
        self.shapes = [(a + 1, b) for a, b in zip(self.sizes, self.sizes[1:], strict=False)]
        self.n = sum(a * b for a, b in self.shapes)
        if self.n > MOST_PARAMETERS:
            raise ValueError(f"more than {MOST_PARAMETERS} parameters")

    def start(self, seed: int) -> np.ndarray:
        """Zeros without hidden layers, else small normal weights."""
        rng = np.random.default_rng(seed)
        return np.concatenate([(np.vstack([np.zeros((1, b)), rng.normal(scale=a**-0.5, size=(a - 1, b))]) if len(self.shapes) > 1 else np.zeros((a, b))).ravel() for a, b in self.shapes])

    def layers(self, w: np.ndarray) -> list[np.ndarray]:
        return [part.reshape(s) for part, s in zip(np.split(w, np.cumsum([a * b for a, b in self.shapes])[:-1]), self.shapes, strict=True)]

    def forward(self, w: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Inputs of each layer and the outputs: probabilities, or a number."""
        into, layers = [x], self.layers(w)
        for k, layer in enumerate(layers):
            z = into[-1] @ layer[1:] + layer[0]
            if k < len(layers) - 1:
                into.append(np.tanh(z))
        if self.classes == 1:
            return into, z
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return into, p / p.sum(axis=1, keepdims=True)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted sums over rows of the loss (cross entropy, or half the squared error) and of its gradient."""
        into, out = self.forward(w, x)
        if self.classes == 1:
            d = out - y[:, None]
            loss = 0.5 * (d[:, 0] ** 2 * weight).sum()
        else:
            hit = y.astype(int)
            loss = -(np.log(np.maximum(out[np.arange(len(hit)), hit], 1e-300)) * weight).sum()
            d = out.copy()
            d[np.arange(len(hit)), hit] -= 1
        d, back = d * weight[:, None], []
        for layer, a in zip(reversed(self.layers(w)), reversed(into), strict=True):
            back.append(np.vstack([d.sum(axis=0), a.T @ d]).ravel())
            d = (d @ layer[1:].T) * (1 - a * a)
        return float(loss), np.concatenate(back[::-1])

    def input_gradient(self, w: np.ndarray, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Gradient, with respect to the inputs, of the score (before the softmax) of each row's ``target``."""
        into, _ = self.forward(w, x)
        d = np.eye(self.sizes[-1])[target]
        for layer, a in zip(reversed(self.layers(w)), reversed(into), strict=True):
            d = (d @ layer[1:].T) * (1 - a * a if a is not into[0] else 1)
        return d

    def score(self, w: np.ndarray, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        into, _ = self.forward(w, x)
        return (into[-1] @ self.layers(w)[-1][1:] + self.layers(w)[-1][0])[np.arange(len(target)), target]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column; one of another length or with a null raises ValueError."""
    flat = column.flatten()
    if flat.null_count or len(flat) != len(column) * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"features of {width} numbers are needed")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def summed(rows: DataFrame, network: Network, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(weight, loss, gradient) added up over all rows (features, label, weight)."""
    sent, width = w.copy(), network.sizes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, gradient = 0.0, 0.0, np.zeros(len(sent))
        for batch in batches:
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            a, b = network.gradient(sent, matrix(batch.column("features"), width), batch.column("label").to_numpy(zero_copy_only=False), weight)
            total, loss, gradient = total + weight.sum(), loss + a, gradient + b
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), "sums": [np.concatenate([[total, loss], gradient]).tobytes()]})

    def together(batches: pa.Table) -> pa.Table:
        return pa.table({"sums": [sum(np.frombuffer(s.as_py()) for s in batches.column("sums")).tobytes()]})

    parts = rows.select("features", "label", "weight").mapInArrow(run, "slot int, sums binary").groupBy("slot").applyInArrow(together, "sums binary").collect()
    sums = sum((np.frombuffer(r.sums) for r in parts), np.zeros(len(w) + 2))
    return sums[0], sums[1], sums[2:]


@dataclass
class GradientTrainer:
    """Rounds of full-batch steps, with a schedule of rates, early stopping on held-out rows and the best weights kept.

    ``fit`` takes rows (features array<double>, label, and weight if there is one); null labels take no part.
    ``hidden``: sizes of hidden layers; ``classes`` 1: regression.
    """

    n_in: int
    classes: int = 2
    hidden: tuple[int, ...] = ()
    rounds: int = 20
    lr: float = 0.1
    optimiser: Callable[[], object] = Ranger
    schedule: Callable[[int, float, int], float] = one_cycle
    patience: int | None = None
    l2: float = 0.0
    seed: int = 42
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.network = Network(self.n_in, tuple(self.hidden), self.classes)
        self.weights = self.network.start(self.seed)

    def _rows(self, rows: DataFrame) -> DataFrame:
        weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
        return rows.where("label IS NOT NULL").select("features", F.col("label").cast("double").alias("label"), weight.alias("weight"))

    def fit(self, rows: DataFrame, valid: DataFrame | None = None) -> GradientTrainer:
        """Weights after the last round, or with ``valid`` those of the least held-out loss; stops after ``patience`` rounds without a lesser one."""
        rows, optimiser, best, bad = self._rows(rows), self.optimiser(), (math.inf, self.weights), 0
        valid = None if valid is None else self._rows(valid)
        self.history = []
        for step in range(self.rounds):
            n, loss, gradient = summed(rows, self.network, self.weights)
            if not n:
                raise ValueError("no rows to train on")
            rate = self.schedule(step, self.lr, self.rounds)
            self.weights = optimiser.step(self.weights, gradient / n + self.l2 * self.weights, rate)
            self.history.append({"round": step, "lr": rate, "loss": loss / n})
            if not np.isfinite(loss) or not np.isfinite(self.weights).all():
                break
            if valid is None:
                continue
            m, held, _ = summed(valid, self.network, self.weights)
            self.history[-1]["valid_loss"] = held / m if m else math.nan
            best, bad = ((held, self.weights), 0) if held < best[0] else (best, bad + 1)
            if self.patience is not None and bad > self.patience:
                break
        if valid is not None:
            self.weights = best[1]
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows with ``pred`` and, for classes, ``probs`` and ``prob``; null where the features are null."""
        network, w, width, classes = self.network, self.weights, self.n_in, self.classes
        kept = [c for c in rows.columns if c not in ("pred", "probs", "prob")]
        more = "pred double" if classes == 1 else "pred int, probs array<double>, prob double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column("features").is_valid().to_numpy(zero_copy_only=False)
                out = np.full((batch.num_rows, classes), np.nan)
                out[known] = network.forward(w, matrix(batch.column("features").drop_null(), width))[1]
                columns = {c: batch.column(c) for c in kept}
                if classes == 1:
                    columns["pred"] = pa.array(out[:, 0], mask=~known)
                else:
                    columns["pred"] = pa.array(np.where(known, out.argmax(axis=1), 0).astype(np.int32), mask=~known)
                    columns["probs"] = pa.array([p.tolist() if k else None for p, k in zip(out, known, strict=True)], pa.list_(pa.float64()))
                    columns["prob"] = pa.array(np.where(known, out.max(axis=1), 0), mask=~known)
                yield pa.RecordBatch.from_pydict(columns)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
        return rows.select(*kept).mapInArrow(run, f"{kinds}, {more}")
