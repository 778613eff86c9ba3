"""Series as matrices: recurrence plots, angular fields, transition fields. Dense ARRAY<ARRAY<DOUBLE>> in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.functions import arrays as A


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distances(a, b=None) -> Column:
    a, b = _c(a), _c(a if b is None else b)
    return F.transform(a, lambda p: F.transform(b, lambda q: F.abs(p - q)))


def percentile_threshold(matrix: Column, percentile: float = 10.0) -> Column:
    return A.let(F.array_sort(F.flatten(matrix)), lambda flat: F.get(flat, F.least(F.floor(F.lit(percentile / 100) * F.size(flat)), F.size(flat) - 1).cast("int")))


def below(matrix: Column, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return A.let(t, lambda t: F.transform(matrix, lambda row: F.transform(row, lambda v: (v < t).cast("double"))))


def recurrence_plot(x, threshold: float | None = None, percentile: float = 10.0) -> Column:
    """1 where the distance is strictly below the threshold, which is a percentile of all distances unless given."""
    return A.let(distances(x), lambda d: below(d, threshold if threshold is not None else percentile_threshold(d, percentile)))


def joint_recurrence(a, b, threshold: float | None = None, percentile: float = 10.0) -> Column:
    """Product of both plots; empty when the lengths differ."""
    p, q = recurrence_plot(a, threshold, percentile), recurrence_plot(b, threshold, percentile)
    both = F.zip_with(p, q, lambda r, s: F.zip_with(r, s, lambda u, v: u * v))
    return F.when(F.size(_c(a)) == F.size(_c(b)), both).otherwise(F.array().cast("array<array<double>>"))


def cross_recurrence(a, b, threshold: float | None = None, percentile: float = 10.0) -> Column:
    return A.let(distances(a, b), lambda d: below(d, threshold if threshold is not None else percentile_threshold(d, percentile)))


def angles(x) -> Column:
    """acos of the values scaled to -1 ... 1; a range below 1e-8 counts as 1e-8."""
    x = _c(x)
    lo, hi = F.array_min(x), F.array_max(x)
    ends = F.struct(lo.alias("lo"), F.greatest(hi - lo, F.lit(1e-8)).alias("span"))
    return A.let(ends, lambda k: F.transform(x, lambda v: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (v - k["lo"]) / k["span"] - 1)))))


def gasf(phi) -> Column:
    """Summation field of a column of angles(): cos(p + q)."""
    return A.let(_c(phi), lambda a: F.transform(a, lambda p: F.transform(a, lambda q: F.cos(p + q))))


def gadf(phi) -> Column:
    """Difference field: sin(p - q)."""
    return A.let(_c(phi), lambda a: F.transform(a, lambda p: F.transform(a, lambda q: F.sin(p - q))))


def scaled_matrix(x, lo: Column, hi: Column) -> Column:
    """Values scaled by bounds of the sample; non-finite cells are 0.5."""
    span = F.greatest(hi - lo, F.lit(1e-8))
    return F.transform(_c(x), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.5).otherwise((v - lo) / span))


def markov_transition_field(x, n_bins: int = 8) -> Column:
    """Extension: the chance, over the series, of a step from the quantile bin of i to that of j."""
    x = _c(x)
    cuts = A.let(F.array_sort(x), lambda o: F.array(*[A.quantile_nearest(o, k / n_bins) for k in range(1, n_bins)]))
    places = A.let(cuts, lambda c: F.transform(x, lambda v: F.size(F.filter(c, lambda k: k <= v))))

    def field(b: Column) -> Column:
        steps = A.pairs(b, 1, lambda p, q: p * n_bins + q)
        left = F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0)))

        def chance(p: Column, q: Column) -> Column:
            n = F.size(F.filter(left, lambda v: v == p))
            return F.when(n > 0, F.size(F.filter(steps, lambda s: s == p * n_bins + q)) / n).otherwise(0.0)

        table = F.transform(A.steps(n_bins), lambda p: F.transform(A.steps(n_bins), lambda q: chance(p, q)))
        return A.let(table, lambda m: F.transform(b, lambda p: F.transform(b, lambda q: F.get(F.get(m, p), q))))

    return A.let(places, field)
