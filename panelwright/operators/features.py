"""Statistical features of each series, in four nested sets of 6, 15, 31 and 45.

All are array expressions of one row, so a set costs one pass and no shuffle however many series there
are. An empty or null series gives nulls (its length 0); moments beyond a zero deviation, and lags beyond
the length, are null. Population moments; nearest-rank quantiles; of equal maxima the last counts, of equal
minima the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import arrays as A

MINIMAL = ["length", "mean", "min", "max", "std", "variance"]
EFFICIENT = [*MINIMAL, "median", "q1", "q3", "iqr", "range", "skewness", "kurtosis", "abs_sum", "rms"]
COMPREHENSIVE = [
    *EFFICIENT, "diff_mean", "diff_std", "diff_abs_sum", "zero_crossing_rate", "mean_crossing_rate", "autocorr_lag1", "autocorr_lag5", "autocorr_lag10",
    "approx_entropy", "count_above_mean", "count_below_mean", "ratio_above_mean", "first_max_location", "first_min_location", "longest_strike_above_mean", "longest_strike_below_mean",
]
ALL = [*COMPREHENSIVE, "diff2_mean", "diff2_std", "energy", "peak_count", *[f"q{q}" for q in (10, 20, 30, 40, 60, 70, 80, 90)], "binned_entropy", "abs_energy"]
SETS = {"minimal": MINIMAL, "efficient": EFFICIENT, "comprehensive": COMPREHENSIVE, "all": ALL}


def _power_sum(x: Column, m: Column, k: int) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + (F.pow(v - m, F.lit(k)) if k > 2 else (v - m) * (v - m)))


def _std(x: Column) -> Column:
    m = A.total(x) / F.nullif(F.size(x), F.lit(0))
    return F.sqrt(_power_sum(x, m, 2) / F.nullif(F.size(x), F.lit(0)))


def _crossings(x: Column, level: Column) -> Column:
    changed = A.pairs(x, 1, lambda a, b: (a >= level) != (b >= level))
    return F.size(F.filter(changed, lambda c: c)) / F.greatest(F.size(x) - 1, F.lit(1))


def autocorrelation(x: Column, mean: Column, square: Column, lag: int) -> Column:
    """Null where the series isn't longer than the lag, 0 without variance."""
    num = A.total(A.pairs(x, lag, lambda a, b: (a - mean) * (b - mean)))
    return F.when(F.size(x) > lag, F.when(square == 0, 0.0).otherwise(num / F.nullif(square, F.lit(0.0))))


def longest_strike(x: Column, test) -> Column:
    """Longest run of values that pass ``test``."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        now = F.when(test(v), a["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(x, zero, step, lambda a: a["best"])


def approximate_entropy(x: Column, r: Column, m: int = 2) -> Column:
    """Self-matches count; quadratic in the length of the series. Windows of m + 1 values that match are looked for among those whose first m do."""
    n = F.size(x) - m + 1

    def alike(a: Column, b: Column, r: Column, places) -> Column:
        out = F.lit(True)
        for k in places:
            out = out & (F.abs(a[f"v{k}"] - b[f"v{k}"]) <= r)
        return out

    def counts(w: Column, r: Column) -> Column:
        def one(a: Column) -> Column:
            near = F.filter(w, lambda b: alike(a, b, r, range(m)))
            more = lambda c: F.when(a[f"v{m}"].isNotNull(), F.size(F.filter(c, lambda b: F.coalesce(alike(a, b, r, [m]), F.lit(False)))))
            return A.let(near, lambda c: F.struct(F.size(c).alias("short"), more(c).alias("long")))

        return F.transform(w, one)

    def phi(found: Column, name: str, n: Column) -> Column:
        return A.total(F.transform(found, lambda c: F.coalesce(F.log(c[name] / n), F.lit(0.0)))) / n

    windows = F.transform(A.steps(n), lambda i: F.struct(*[F.get(x, i + k).alias(f"v{k}") for k in range(m + 1)]))
    found = A.let(windows, lambda w: A.let(r, lambda r: counts(w, r)))
    return F.when(F.size(x) >= 10, A.let(found, lambda c: phi(c, "short", n) - phi(c, "long", n - 1)))


def binned_entropy(x: Column, lo: Column, hi: Column, bins: int = 10) -> Column:
    width = (hi - lo) / bins
    place = F.transform(x, lambda v: F.least(F.floor((v - lo) / width), F.lit(bins - 1)))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(place, lambda p: p == b)) / F.size(x))
    h = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return F.when(F.abs(hi - lo) < 1.1920929e-07, 0.0).otherwise(h)  # fixed value: the smallest float32 step at 1


def features(panel: DataFrame, which: str = "all", x: str = "x") -> DataFrame:
    """The panel's columns without ``x``, and the features of the set ``which``."""
    names = SETS[which]
    keys = [c for c in panel.columns if c != x]
    v = F.col("_x")
    a = panel.select(*keys, F.coalesce(F.col(x), F.array().cast("array<double>")).cast("array<double>").alias("_x"))
    n = F.nullif(F.size(v), F.lit(0))
    b = a.select("*", F.array_sort(v).alias("_o"), (A.total(v) / n).alias("mean"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), A.differences(v).alias("_d"))
    c = b.select("*", _power_sum(v, F.col("mean"), 2).alias("_ss"), A.pairs("_d", 1, lambda p, q: q - p).alias("_dd"))
    d = c.select("*", (F.col("_ss") / n).alias("variance"), F.sqrt(F.col("_ss") / n).alias("std"))
    o, mean, std, lo, hi = F.col("_o"), F.col("mean"), F.col("std"), F.col("min"), F.col("max")
    some, longer = F.size(v) > 0, F.size(v) > 1
    above, below = F.size(F.filter(v, lambda y: y > mean)), F.size(F.filter(v, lambda y: y < mean))
    square = A.total(F.transform(v, lambda y: y * y))
    mean_of = lambda y: A.total(y) / F.nullif(F.size(y), F.lit(0))
    made = {
        "length": F.size(v).cast("long"), "mean": mean, "min": lo, "max": hi, "std": std, "variance": F.col("variance"),
        "median": A.median(o), "q1": A.quantile_nearest(o, 0.25), "q3": A.quantile_nearest(o, 0.75), "iqr": A.quantile_nearest(o, 0.75) - A.quantile_nearest(o, 0.25), "range": hi - lo,
        "skewness": F.when(std > 0, _power_sum(v, mean, 3) / n / F.pow(std, F.lit(3))), "kurtosis": F.when(std > 0, _power_sum(v, mean, 4) / n / F.pow(std, F.lit(4)) - 3),
        "abs_sum": F.when(some, A.total(F.transform(v, F.abs))), "rms": F.sqrt(square / n),
        "diff_mean": mean_of(F.col("_d")), "diff_std": _std(F.col("_d")), "diff_abs_sum": F.when(longer, A.total(F.transform("_d", F.abs))),
        "zero_crossing_rate": F.when(some, _crossings(v, F.lit(0.0))), "mean_crossing_rate": F.when(some, _crossings(v, mean)),
        **{f"autocorr_lag{k}": autocorrelation(v, mean, F.col("_ss"), k) for k in (1, 5, 10)},
        "approx_entropy": approximate_entropy(v, 0.2 * std),
        "count_above_mean": F.when(some, above).cast("long"), "count_below_mean": F.when(some, below).cast("long"), "ratio_above_mean": above / n,
        "first_max_location": A.argmax_last(v) / n, "first_min_location": A.argmin_first(v) / n,
        "longest_strike_above_mean": F.when(some, longest_strike(v, lambda y: y > mean)).cast("long"), "longest_strike_below_mean": F.when(some, longest_strike(v, lambda y: y < mean)).cast("long"),
        "diff2_mean": mean_of(F.col("_dd")), "diff2_std": _std(F.col("_dd")), "energy": F.when(some, square),
        "peak_count": F.when(some, F.size(F.filter(A.steps(F.size(v) - 2), lambda i: (F.get(v, i + 1) > F.get(v, i)) & (F.get(v, i + 1) > F.get(v, i + 2)) & (F.get(v, i + 1) > 0.1 * std)))).cast("long"),
        **{f"q{q}": A.quantile_nearest(o, q / 100) for q in (10, 20, 30, 40, 60, 70, 80, 90)},
        "binned_entropy": F.when(some, binned_entropy(v, lo, hi)), "abs_energy": F.when(some, square),
    }
    return d.select(*keys, *[made[name].alias(name) for name in names])


def multivariate(panel: DataFrame, which: str, n_vars: int) -> DataFrame:
    """One row a sample with columns var{i}__{feature}; the variables are a fixed list, so no pivot has to look for them."""
    each = features(panel, which)
    names = SETS[which]
    picked = [F.max(F.when(F.col("var_id") == i, F.col(f))).alias(f"var{i}__{f}") for i in range(n_vars) for f in names]
    return each.groupBy("sample_id").agg(*picked)


def variable_correlations(panel: DataFrame) -> DataFrame:
    """(sample_id, var_i, var_j, corr) for i < j of equal length; 0 where either is constant. The variables of a sample meet in one row, not in a self-join."""
    together = panel.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("var_id", "x"))).alias("v"))
    n = F.size("v")
    ij = F.flatten(F.transform(A.steps(n), lambda i: F.transform(A.steps(n - i - 1), lambda k: F.struct(i.alias("i"), (i + k + 1).alias("j")))))
    two = together.select("sample_id", "v", F.explode(ij).alias("p")).select("sample_id", F.get("v", F.col("p.i")).alias("a"), F.get("v", F.col("p.j")).alias("b"))
    two = two.where(F.size("a.x") == F.size("b.x")).select("sample_id", F.col("a.var_id").alias("var_i"), F.col("b.var_id").alias("var_j"), F.col("a.x").alias("a"), F.col("b.x").alias("b"))
    m = two.select("*", (A.total("a") / F.size("a")).alias("ma"), (A.total("b") / F.size("b")).alias("mb"))
    cov = F.aggregate(F.zip_with("a", "b", lambda p, q: (p - F.col("ma")) * (q - F.col("mb"))), F.lit(0.0), lambda s, v: s + v)
    va, vb = _power_sum(F.col("a"), F.col("ma"), 2), _power_sum(F.col("b"), F.col("mb"), 2)
    return m.select("sample_id", "var_i", "var_j", F.when((va == 0) | (vb == 0), 0.0).otherwise(cov / F.nullif(F.sqrt(va * vb), F.lit(0.0))).alias("corr"))


def notebook_features(panel: DataFrame) -> DataFrame:
    """mean, std, min, max, median, p25 and p75 with linear percentiles."""
    o = panel.select("sample_id", "var_id", "x", F.array_sort("x").alias("o"))
    mean = A.total("x") / F.size("x")
    return o.select("sample_id", "var_id", mean.alias("mean"), _std(F.col("x")).alias("std"), F.array_min("x").alias("min"), F.array_max("x").alias("max"), A.median("o").alias("median"), A.quantile_linear("o", 0.25).alias("p25"), A.quantile_linear("o", 0.75).alias("p75"))
