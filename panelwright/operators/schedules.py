"""Learning-rate and probability schedules as expressions of a step or epoch column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cos(progress: Column) -> Column:
    return (1 + F.cos(F.pi() * progress)) / 2


def one_cycle(step: Column, max_lr: float, total: int, start_share: float = 0.3, div: float = 25.0, final_div: float = 1e4) -> Column:
    """Linear from max / div over int(share total) steps, then cosine to max / final_div."""
    s, warm = F.least(step, F.lit(max(total - 1, 0))), int(total * start_share)
    lo, end = max_lr / div, max_lr / final_div
    return F.when(s < warm, lo + (max_lr - lo) * s / max(warm, 1)).otherwise(end + (max_lr - end) * _cos((s - warm) / (total - warm)))


def constant(step: Column, lr: float) -> Column:
    return F.lit(float(lr))


def cosine(step: Column, lr: float, least: float, total: int) -> Column:
    return least + (lr - least) * _cos(F.least(step, F.lit(max(total - 1, 0))) / total)


def step_decay(step: Column, lr: float, size: int, gamma: float) -> Column:
    return lr * F.pow(F.lit(gamma), F.floor(step / size))


def exponential(step: Column, lr: float, gamma: float) -> Column:
    return lr * F.pow(F.lit(gamma), step)


def polynomial(step: Column, lr: float, end: float, total: int, power: float) -> Column:
    p = F.least(step, F.lit(total)) / total
    return end + (lr - end) * F.pow(1 - p, F.lit(power))


def warm_restarts(step: Column, lr: float, least: float, first: int, mult: int = 1) -> Column:
    """Cosine cycles of first, first mult, first mult^2, ... steps."""
    if mult <= 1:
        start, length = F.floor(step / first) * first, F.lit(first)
    else:
        k = F.floor(F.log(1 + step * (mult - 1) / first) / math.log(mult) + 1e-12)
        start, length = first * (F.pow(F.lit(mult), k) - 1) / (mult - 1), first * F.pow(F.lit(mult), k)
    return least + (lr - least) * _cos((step - start) / length)


def linear_warmup(step: Column, steps: int, start: float, inner: Column, inner_at_zero: float) -> Column:
    """From ``start`` to the inner schedule's first value, then the inner schedule (of step - steps)."""
    return F.when(step < steps, start + (inner_at_zero - start) * step / max(steps, 1)).otherwise(inner)


def probability(epoch: Column, kind: str, n_epochs: int, **a) -> Column:
    """``constant`` p; ``warmup`` max_p, epochs; ``cooldown`` max_p, epochs; ``cosine`` min_p, max_p; ``steps`` table of (epoch, p); ``delayed`` p, start."""
    if kind == "constant":
        return F.lit(a["p"])
    if kind == "warmup":
        return F.when(epoch >= a["epochs"], a["max_p"]).otherwise(a["max_p"] * epoch / max(a["epochs"], 1))
    if kind == "cooldown":
        start = max(n_epochs - a["epochs"], 0)
        return F.when(epoch < start, a["max_p"]).otherwise(a["max_p"] * (1 - (epoch - start) / max(a["epochs"], 1)))
    if kind == "cosine":
        return F.lit((a["min_p"] + a["max_p"]) / 2) if n_epochs <= 1 else a["min_p"] + (a["max_p"] - a["min_p"]) * _cos(epoch / (n_epochs - 1))
    if kind == "steps":
        out = F.lit(a["table"][0][1] if a["table"] else 0.5)
        for at, p in a["table"]:
            out = F.when(epoch >= at, p).otherwise(out)
        return out
    if kind == "delayed":
        return F.when(epoch >= a["start"], a["p"]).otherwise(0.0)
    raise ValueError(f"unknown schedule {kind}")


class PlateauReducer:
    """Lowers the rate by ``factor`` when the metric hasn't improved for more than ``patience`` epochs; then rests for ``cooldown``."""

    def __init__(self, lr: float, factor: float = 0.1, patience: int = 10, cooldown: int = 0, least: float = 0.0, min_delta: float = 1e-4, lower_is_better: bool = True):
        self.lr, self.factor, self.patience, self.cooldown, self.least, self.min_delta, self.lower = lr, factor, patience, cooldown, least, min_delta, lower_is_better
        self.best, self.bad, self.rest = None, 0, 0

    def step(self, metric: float) -> float:
        better = self.best is None or (metric < self.best - self.min_delta if self.lower else metric > self.best + self.min_delta)
        if better:
            self.best, self.bad = metric, 0
        elif self.rest:
            self.rest -= 1
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.lr, self.bad, self.rest = max(self.lr * self.factor, self.least), 0, self.cooldown
        return self.lr


def positional_encoding(position: Column, dim: Column, d_model: int) -> Column:
    """Sinusoidal encoding: sine in even places, cosine in odd ones, of position / 10000^(2 (dim div 2) / d_model)."""
    angle = position / F.pow(F.lit(10000.0), 2 * F.floor(dim / 2) / d_model)
    return F.when(dim % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
