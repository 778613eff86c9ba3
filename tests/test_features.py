import math

import pytest

from panelwright.operators import features as X


def panel(spark, *series):
    return spark.createDataFrame([(i, 0, list(map(float, s))) for i, s in enumerate(series)], "sample_id long, var_id int, x array<double>")


def test_set_sizes():
    assert [len(X.SETS[s]) for s in ("minimal", "efficient", "comprehensive", "all")] == [6, 15, 31, 45]


def test_ramp_and_constants(spark):
    ramp, flat = X.features(panel(spark, range(1, 11), [1.0] * 100), "all").orderBy("sample_id").collect()
    assert (ramp.length, ramp.mean, ramp.min, ramp.max, ramp.median) == (10, 5.5, 1, 10, 5.5)
    assert ramp.autocorr_lag1 == pytest.approx(0.7)
    assert ramp.autocorr_lag10 is None and ramp.longest_strike_above_mean == 5
    assert flat.binned_entropy == 0 and flat.skewness is None and flat.autocorr_lag1 == 0


def test_alternating_and_ties(spark):
    alt, tie = X.features(panel(spark, [1, -1] * 4, [2, 5, 1, 5, 1]), "all").orderBy("sample_id").collect()
    assert alt.autocorr_lag1 < 0 and alt.zero_crossing_rate == 1
    assert tie.first_max_location == pytest.approx(3 / 5) and tie.first_min_location == pytest.approx(2 / 5)


def test_empty_series(spark):
    row = X.features(panel(spark, []), "all").first()
    assert row.length == 0 and row.mean is None and row.peak_count is None


def test_correlation(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0]), (0, 1, [3.0, 2.0, 1.0]), (0, 2, [1.0, 1.0, 1.0])], "sample_id long, var_id int, x array<double>")
    got = {(r.var_i, r.var_j): r["corr"] for r in X.variable_correlations(df).collect()}
    assert got[0, 1] == pytest.approx(-1) and got[0, 2] == 0


def test_entropy_of_a_line(spark):
    assert X.features(panel(spark, range(100)), "all").first().binned_entropy == pytest.approx(math.log(10))
