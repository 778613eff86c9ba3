"""Search, explanation, classifier and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import explain, search
from panelwright.plans.registry import query
from panelwright.plans.tables import E, Q, S, events_panel, r, rr, table, vectors
from panelwright.streaming.windows import windowed_features


@query("hpo_leaderboard", f"SELECT vec_id AS trial_id, {rr('embedding[1]::DOUBLE')} AS score FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 10")
def hpo_leaderboard(spark, sf_dir):
    t = vectors(spark, sf_dir).select(F.col("sample_id").alias("trial_id"), F.get("x", F.lit(0)).alias("score"))
    return search.leaderboard(t).select("trial_id", r("score").alias("score"))


_CAM = "g AS (SELECT sample_id, var_id % 2 AS c, var_id // 2 AS k, t, v FROM q), w AS (SELECT sample_id, c, avg(v) AS w FROM g WHERE k = 1 GROUP BY 1, 2), m AS (SELECT g.sample_id, g.t, greatest(sum(g.v * w.w), 0) AS v FROM g JOIN w USING (sample_id, c) WHERE k = 0 GROUP BY 1, 2)"


@query("grad_cam", f"WITH {E}, {Q}, {_CAM} SELECT sample_id, t, CASE WHEN v > 0 THEN {rr('v / max(v) OVER (PARTITION BY sample_id)')} ELSE 0 END AS cam FROM m")
def grad_cam(spark, sf_dir):
    v = vectors(spark, sf_dir)
    part = lambda i: F.slice("x", i * 16 + 1, 16)
    cam = v.select("sample_id", explain.grad_cam(F.array(part(0), part(1)), F.array(part(2), part(3))).alias("cam"))
    return cam.select("sample_id", F.posexplode("cam").alias("t", "c")).select("sample_id", "t", F.when(F.col("c") > 0, r("c")).otherwise(0.0).alias("cam"))


@query("event_windows", f"SELECT user_id AS sample_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, {rr('avg(value)')} AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return windowed_features(e, "user_id", "ts", "value", "7 days").select("sample_id", "start", "n", r("mean").alias("mean"), "min", "max")


@query("rocket_classifier")
def rocket_classifier(spark, sf_dir):
    from panelwright.operators.training import SeriesClassifier

    v = vectors(spark, sf_dir)
    fitted = SeriesClassifier(n_kernels=84, max_iter=15).fit(v, v.select("sample_id", "label"))
    return fitted.predict(v).select("sample_id", "pred", "prob")


_FORECAST = f"""
WITH {S}, p AS (SELECT sample_id, t, v, lead(v) OVER (PARTITION BY sample_id ORDER BY t) AS w FROM e),
c AS (SELECT regr_slope(w, v) AS b, regr_intercept(w, v) AS a FROM p WHERE w IS NOT NULL)
SELECT sample_id, {rr('a + b * v', 5)} AS forecast FROM (SELECT sample_id, arg_max(v, t) AS v FROM e GROUP BY 1), c
"""


@query("forecaster", _FORECAST)
def forecaster(spark, sf_dir):
    """The next value of each user's series by the line through all pairs of neighbours, fitted as the forecaster of a window of one."""
    from panelwright.operators.training import SeriesForecaster

    panel = events_panel(spark, sf_dir)
    made = SeriesForecaster(1, 1, reg=0.0).fit(panel).predict(panel)
    return made.select("sample_id", r(F.get("forecast", F.lit(0)), 5).alias("forecast"))
