"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import features as X
from panelwright.plans.registry import query
from panelwright.plans.tables import E, Q, S, events_panel, quarters, r, rounded, rr, vectors

_WHOLE = {"length", "count_above_mean", "count_below_mean", "longest_strike_above_mean", "longest_strike_below_mean", "peak_count"}

_DIFF = """d AS (SELECT sample_id, t, v, v - lag(v) OVER w AS d, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2, lag(v) OVER w AS p, lead(v) OVER w AS nx,
  avg(v) OVER (PARTITION BY sample_id) AS m, stddev_pop(v) OVER (PARTITION BY sample_id) AS s, min(v) OVER (PARTITION BY sample_id) AS lo, max(v) OVER (PARTITION BY sample_id) AS hi,
  lead(v, 5) OVER w AS n5, lead(v, 10) OVER w AS n10, row_number() OVER (PARTITION BY sample_id ORDER BY v) - 1 AS rk, count(*) OVER (PARTITION BY sample_id) AS n
  FROM e WINDOW w AS (PARTITION BY sample_id ORDER BY t))"""
_Q = lambda name, q: f"max(v) FILTER (WHERE rk = round({q}::DOUBLE * (n - 1))) AS {name}"
_RUNS = """runs AS (SELECT sample_id, max(up) AS longest_strike_above_mean, max(dn) AS longest_strike_below_mean FROM (
  SELECT sample_id, g, count(*) FILTER (WHERE v > m) AS up, count(*) FILTER (WHERE v < m) AS dn FROM (
    SELECT *, CASE WHEN v > m THEN 1 WHEN v < m THEN 2 ELSE 0 END AS side,
      row_number() OVER (PARTITION BY sample_id ORDER BY t) - row_number() OVER (PARTITION BY sample_id, CASE WHEN v > m THEN 1 WHEN v < m THEN 2 ELSE 0 END ORDER BY t) AS g FROM d)
  GROUP BY sample_id, side, g) GROUP BY sample_id)"""
_BINS = """bins AS (SELECT sample_id, CASE WHEN hi - lo < 1.1920929e-07 THEN 0 ELSE -sum(k / n * ln(k / n)) END AS binned_entropy FROM (
  SELECT sample_id, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS b, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, max(hi) AS hi, max(lo) AS lo FROM d GROUP BY 1, 2) GROUP BY sample_id, hi, lo)"""
_APEN = """a2 AS (SELECT a.sample_id, a.t, count(*) AS c FROM d a JOIN d b ON a.sample_id = b.sample_id AND abs(a.v - b.v) <= 0.2 * a.s AND abs(a.nx - b.nx) <= 0.2 * a.s GROUP BY 1, 2),
a3 AS (SELECT a.sample_id, a.t, count(*) AS c FROM (SELECT *, lead(v, 2) OVER (PARTITION BY sample_id ORDER BY t) AS n2 FROM d) a JOIN (SELECT *, lead(v, 2) OVER (PARTITION BY sample_id ORDER BY t) AS n2 FROM d) b
  ON a.sample_id = b.sample_id AND abs(a.v - b.v) <= 0.2 * a.s AND abs(a.nx - b.nx) <= 0.2 * a.s AND abs(a.n2 - b.n2) <= 0.2 * a.s GROUP BY 1, 2),
apen AS (SELECT sample_id, p2 - p3 AS approx_entropy FROM (SELECT a2.sample_id, avg(ln(a2.c / (n.n - 1))) AS p2 FROM a2 JOIN (SELECT DISTINCT sample_id, n FROM d) n USING (sample_id) GROUP BY 1)
  JOIN (SELECT a3.sample_id, avg(ln(a3.c / (n.n - 2))) AS p3 FROM a3 JOIN (SELECT DISTINCT sample_id, n FROM d) n USING (sample_id) GROUP BY 1) USING (sample_id))"""
_FORMULA = {
    "length": "max(n) AS length", "mean": "avg(v) AS mean", "min": "min(v) AS min", "max": "max(v) AS max", "std": "stddev_pop(v) AS std", "variance": "var_pop(v) AS variance",
    "median": "median(v) AS median", "q1": _Q("q1", 0.25), "q3": _Q("q3", 0.75), "iqr": "max(v) FILTER (WHERE rk = round(0.75::DOUBLE * (n - 1))) - max(v) FILTER (WHERE rk = round(0.25::DOUBLE * (n - 1))) AS iqr", "range": "max(v) - min(v) AS range",
    "skewness": "avg(power((v - m) / s, 3)) AS skewness", "kurtosis": "avg(power((v - m) / s, 4)) - 3 AS kurtosis", "abs_sum": "sum(abs(v)) AS abs_sum", "rms": "sqrt(avg(v * v)) AS rms",
    "diff_mean": "avg(d) AS diff_mean", "diff_std": "stddev_pop(d) AS diff_std", "diff_abs_sum": "sum(abs(d)) AS diff_abs_sum",
    "zero_crossing_rate": "count(*) FILTER (WHERE (v >= 0) <> (p >= 0)) / (max(n) - 1) AS zero_crossing_rate", "mean_crossing_rate": "count(*) FILTER (WHERE (v >= m) <> (p >= m)) / (max(n) - 1) AS mean_crossing_rate",
    "autocorr_lag1": "sum((v - m) * (nx - m)) / sum((v - m) * (v - m)) AS autocorr_lag1", "autocorr_lag5": "sum((v - m) * (n5 - m)) / sum((v - m) * (v - m)) AS autocorr_lag5", "autocorr_lag10": "sum((v - m) * (n10 - m)) / sum((v - m) * (v - m)) AS autocorr_lag10",
    "count_above_mean": "count(*) FILTER (WHERE v > m) AS count_above_mean", "count_below_mean": "count(*) FILTER (WHERE v < m) AS count_below_mean", "ratio_above_mean": "count(*) FILTER (WHERE v > m) / max(n) AS ratio_above_mean",
    "first_max_location": "max(t) FILTER (WHERE v = hi) / max(n) AS first_max_location", "first_min_location": "min(t) FILTER (WHERE v = lo) / max(n) AS first_min_location",
    "diff2_mean": "avg(d2) AS diff2_mean", "diff2_std": "stddev_pop(d2) AS diff2_std", "energy": "sum(v * v) AS energy", "peak_count": "count(*) FILTER (WHERE v > p AND v > nx AND v > 0.1 * s) AS peak_count",
    **{f"q{q}": _Q(f"q{q}", f"0.{q // 10}") for q in (10, 20, 30, 40, 60, 70, 80, 90)}, "abs_energy": "sum(v * v) AS abs_energy",
}
_SIDE = {"longest_strike_above_mean": ("runs", _RUNS), "longest_strike_below_mean": ("runs", _RUNS), "binned_entropy": ("bins", _BINS), "approx_entropy": ("apen", _APEN)}


def feature_sql(names: list[str], source: str, digits: int = 6) -> str:
    tables = dict(_SIDE[n] for n in names if n in _SIDE)
    plain = ", ".join(_FORMULA[n] for n in names if n in _FORMULA) or "1 AS one"
    out = ", ".join(f"{n}::BIGINT AS {n}" if n in _WHOLE else f"{rr(n, digits)} AS {n}" for n in names)
    return f"WITH {source}, {_DIFF}{''.join(', ' + t for t in tables.values())}, f AS (SELECT sample_id, {plain} FROM d GROUP BY sample_id) SELECT sample_id, {out} FROM f" + "".join(f" JOIN {t} USING (sample_id)" for t in tables)


def _shown(df, names, digits=6):
    return df.select("sample_id", *[F.col(n) if n in _WHOLE else r(n, digits).alias(n) for n in names])


def _register(name: str, which: str, names: list[str], ragged: bool = False) -> None:
    @query(name, feature_sql(names, S if ragged else E))
    def run(spark, sf_dir):
        panel = events_panel(spark, sf_dir) if ragged else vectors(spark, sf_dir)
        return _shown(X.features(panel.select("sample_id", "x"), which), names)


for _set in X.SETS:
    _register(f"features_{_set}", _set, X.SETS[_set])
_register("features_all_ragged", "all", X.ALL, ragged=True)
for _name, _set, _names in [
    ("diff_stats", "all", ["diff_mean", "diff_std", "diff_abs_sum", "diff2_mean", "diff2_std"]), ("crossing_rates", "comprehensive", ["zero_crossing_rate", "mean_crossing_rate"]),
    ("autocorr", "comprehensive", ["autocorr_lag1", "autocorr_lag5", "autocorr_lag10"]), ("longest_strike", "comprehensive", ["longest_strike_above_mean", "longest_strike_below_mean"]),
    ("peaks", "all", ["peak_count"]), ("binned_entropy", "all", ["binned_entropy"]), ("approx_entropy", "comprehensive", ["approx_entropy"]), ("quantiles_nearest", "all", [f"q{q}" for q in (10, 20, 30, 40, 60, 70, 80, 90)]),
    ("extreme_locations", "comprehensive", ["first_max_location", "first_min_location"]),
]:
    _register(_name, _set, _names, ragged=True)


@query("multivariate_features", f"WITH {E}, {Q} SELECT sample_id, " + ", ".join(f"{rr(f'avg(v) FILTER (WHERE var_id = {i})')} AS var{i}__mean, {rr(f'stddev_pop(v) FILTER (WHERE var_id = {i})')} AS var{i}__std, max(v) FILTER (WHERE var_id = {i}) AS var{i}__max" for i in range(4)) + " FROM q GROUP BY 1")
def multivariate_features(spark, sf_dir):
    wide = X.multivariate(quarters(spark, sf_dir).select("sample_id", "var_id", "x"), "minimal", 4)
    return wide.select("sample_id", *[c for i in range(4) for c in (r(f"var{i}__mean").alias(f"var{i}__mean"), r(f"var{i}__std").alias(f"var{i}__std"), F.col(f"var{i}__max"))])


@query("var_correlation", f"WITH {E}, {Q} SELECT a.sample_id, a.var_id AS var_i, b.var_id AS var_j, {rr("corr(a.v, b.v)")} AS corr FROM q a JOIN q b ON a.sample_id = b.sample_id AND a.t = b.t AND a.var_id < b.var_id GROUP BY 1, 2, 3")
def var_correlation(spark, sf_dir):
    return X.variable_correlations(quarters(spark, sf_dir)).select("sample_id", "var_i", "var_j", r("corr").alias("corr"))


@query("notebook_features", f"WITH {E} SELECT sample_id, {rounded('mean std median p25 p75')}, min, max FROM (SELECT sample_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, median(v) AS median, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75 FROM e GROUP BY 1)")
def notebook_features(spark, sf_dir):
    f = X.notebook_features(vectors(spark, sf_dir))
    return f.select("sample_id", *[r(c).alias(c) for c in ("mean", "std", "median", "p25", "p75")], "min", "max")
