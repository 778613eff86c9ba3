"""Array expressions over a series. Positions are 0-based; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value) with the value computed once a row, however often f reads it; inside lambdas nothing else stops it from being computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def steps(n: Column | int) -> Column:
    """0, 1, ... n - 1; empty for n < 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def total(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def at(x: Column | str, i: Column) -> Column:
    return F.get(col(x), i.cast("int"))


def pairs(x: Column | str, lag: int, f) -> Column:
    """f(x[t], x[t + lag]) for each t that has both."""
    x = col(x)
    n = F.greatest(F.size(x) - lag, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(lag + 1), n), f)


def differences(x: Column | str) -> Column:
    return pairs(x, 1, lambda a, b: b - a)


def quantile_nearest(ordered: Column | str, q: float) -> Column:
    """Value of a sorted array at round(q (n - 1))."""
    o = col(ordered)
    return F.get(o, F.round(F.lit(q) * (F.size(o) - 1)).cast("int"))


def quantile_linear(ordered: Column | str, q: float) -> Column:
    o = col(ordered)
    p = F.lit(q) * (F.size(o) - 1)
    lo = F.floor(p).cast("int")
    hi = F.least(lo + 1, F.size(o) - 1)
    return F.get(o, lo) * (1 - (p - lo)) + F.get(o, hi) * (p - lo)


def median(ordered: Column | str) -> Column:
    o = col(ordered)
    n = F.size(o)
    return (F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int"))) / 2


def argmax_last(x: Column | str) -> Column:
    """Position of the maximum, the last one of equals."""
    x = col(x)
    return F.size(x) - F.array_position(F.reverse(x), F.array_max(x)).cast("int")


def argmin_first(x: Column | str) -> Column:
    return F.array_position(col(x), F.array_min(col(x))).cast("int") - 1


def softmax(logits: Column | str, temperature: float | Column = 1.0) -> Column:
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(1e-6))
    powers = lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp((v - top) / t)))
    return let(col(logits), lambda z: let(powers(z), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))))


def lerp(x: Column | str, n: Column | int, kernel: str = "ends") -> Column:
    """Linear resampling to ``n`` steps. ``ends``: first and last fall on first and last. ``short``: step t reads t / n (L - 1), which never reaches the last."""
    x = col(x)
    n = (n if isinstance(n, Column) else F.lit(n)).cast("int")
    return let(x, lambda x: let(n, lambda n: _lerp(x, n, kernel)))


def _lerp(x: Column, n: Column, kernel: str) -> Column:
    top = F.size(x) - 1

    def value(t: Column) -> Column:
        src = t * top / F.greatest(n - 1, F.lit(1)) if kernel == "ends" else t / n * top
        lo = F.floor(src).cast("int")
        f = src - lo
        return F.get(x, lo) * (1 - f) + F.get(x, F.least(lo + 1, top)) * f

    return F.transform(steps(n), value)


def lookup(x: Column | str, src: Column) -> Column:
    """Linear look-up at a fractional place, clamped to the series."""
    x = col(x)
    top = F.size(x) - 1

    def value(p: Column) -> Column:
        lo = F.floor(p).cast("int")
        return F.get(x, lo) * (1 - (p - lo)) + F.get(x, F.least(lo + 1, top)) * (p - lo)

    return let(F.greatest(F.lit(0.0), F.least(src, top.cast("double"))), value)


def roll(x: Column | str, k: Column | int) -> Column:
    """Circular shift: step t reads t - k."""
    x = col(x)
    k = k if isinstance(k, Column) else F.lit(k)
    return let(k, lambda k: F.transform(x, lambda v, t: F.get(x, F.pmod(t - k, F.size(x)).cast("int"))))


def shift(x: Column | str, k: Column | int, fill: float = 0.0) -> Column:
    """Shift by k steps; cells that open up get ``fill``."""
    x = col(x)
    k = k if isinstance(k, Column) else F.lit(k)
    return let(k, lambda k: F.transform(x, lambda v, t: F.when((t - k >= 0) & (t - k < F.size(x)), F.get(x, (t - k).cast("int"))).otherwise(F.lit(fill))))


def pad(x: Column | str, n: int | Column, value: float = 0.0, side: str = "post") -> Column:
    """To ``n`` steps exactly: longer series are cut at the end."""
    x = col(x)
    n = (n if isinstance(n, Column) else F.lit(n)).cast("int")
    more = F.array_repeat(F.lit(float(value)), F.greatest(n - F.size(x), F.lit(0)))
    return F.slice(F.concat(x, more) if side == "post" else F.concat(more, x), 1, n)


def weighted(x: Column | str, weights: list[float], normalise: str) -> Column:
    """Centred weighted window. At the edges the sum is divided by the weights inside (``inside``) or scaled by absolute weights (``absolute``)."""
    half = len(weights) // 2
    w = F.array(*[F.lit(float(v)) for v in weights])
    whole = sum(abs(v) for v in weights)

    def value(x: Column, t: Column) -> Column:
        n = F.size(x)
        k = F.filter(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda j: (t - half + j >= 0) & (t - half + j < n))
        s = F.aggregate(k, F.lit(0.0), lambda a, j: a + F.get(x, t - half + j) * F.get(w, j))
        d = F.aggregate(k, F.lit(0.0), lambda a, j: a + F.abs(F.get(w, j)))
        return s / d * (whole if normalise == "absolute" else 1.0)

    return let(col(x), lambda x: F.transform(x, lambda v, t: value(x, t)))


def running_mean(x: Column | str, window: int) -> Column:
    """Mean of the window t - w/2 ... t - w/2 + w - 1 as far as it lies inside the series."""
    half = window // 2

    def mean(x: Column, t: Column) -> Column:
        lo = F.greatest(t - half, F.lit(0))
        hi = F.least(t - half + window, F.size(x))
        return F.aggregate(F.slice(x, lo + 1, hi - lo), F.lit(0.0), lambda a, u: a + u) / (hi - lo)

    return let(col(x), lambda x: F.transform(x, lambda v, t: mean(x, t)))
