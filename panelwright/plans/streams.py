"""Streams over the test tables: parts of them are micro-batches, and the result is compared with SQL over the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import losses
from panelwright.plans.metrics import DYNAMICS_SQL, history
from panelwright.plans.registry import query
from panelwright.plans.tables import E, r, rounded, rr, table, vectors
from panelwright.session import scratch
from panelwright.streaming.dynamics import prediction_dynamics
from panelwright.streaming.runs import VersionedState, averaged, latest, run_batches
from panelwright.streaming.sessions import run_sessions


def _streams(parts, folder: str):
    """A stream after each of ``parts`` has come, to be run at one checkpoint before the next is asked for.

    A run takes its part as one micro-batch, in however many files the part's tasks wrote it.
    """
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part={i}")
        yield part.sparkSession.readStream.schema(parts[0].schema).parquet(f"{folder}/in/part=*")


@query("stream_prediction_dynamics", DYNAMICS_SQL + f" SELECT sample_id, epochs, ever_correct, always_correct, flips, first_correct::INT AS first_correct, last_incorrect::INT AS last_incorrect, regressed, last AS last_correct, {rounded('stability mean_confidence')} FROM d")
def stream_prediction_dynamics(spark, sf_dir):
    """Late epochs (the even ones come last) and repeated ones (every seventh comes twice)."""
    h, folder = history(spark, sf_dir), scratch(spark, "dynamics-stream")
    parts = [h.where("epoch % 2 = 1"), h.where("epoch % 2 = 0 OR epoch % 7 = 0")]
    for stream in _streams(parts, folder):
        got = latest(prediction_dynamics(stream), "sample_id", folder)
    return got.select("sample_id", "epochs", "ever_correct", "always_correct", "flips", "first_correct", "last_incorrect", "regressed", "last_correct", r("stability").alias("stability"), r("mean_confidence").alias("mean_confidence"))


_SESSIONS = f"""
WITH g AS (SELECT user_id, ts, value, coalesce(ts >= lag(ts) OVER o + INTERVAL 6 HOUR, true)::INT AS is_new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id AS sample_id, min(ts) AS start, max(ts) AS last, count(value) AS n, {rr('sum(value)', 4)} AS total, min(value) AS least, max(value) AS greatest FROM s GROUP BY user_id, session
"""


@query("stream_sessions", _SESSIONS)
def stream_sessions(spark, sf_dir):
    """Events in two micro-batches by time, and a mark far behind them that lets the watermark pass the last sessions."""
    e, folder = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value"), scratch(spark, "sessions-stream")
    cut = e.agg(F.percentile_approx(F.unix_micros("ts"), 0.5), F.max("ts")).first()
    mark = spark.createDataFrame([(None, cut[1], None)], e.schema).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    early = F.unix_micros("ts") <= cut[0]
    for stream in _streams([e.where(early), e.where(~early), mark], folder):
        got, late = run_sessions(stream, folder, key="user_id", ts="ts", value="value", gap="6 hours", late="1 hour")
        if late:
            raise ValueError(f"{late} rows came late")
    local = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")}
    return got.where("sample_id IS NOT NULL").withColumns(local | {"total": r("total", 4)})


_CENTERS = f"""
WITH {E}, m AS (SELECT label, t, (sample_id % 3)::INT AS b, avg(v) AS m FROM e GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT label, t FROM e),
a AS (SELECT k.*, 0.5 * m AS c FROM k LEFT JOIN (FROM m WHERE b = 0) USING (label, t)),
b AS (SELECT a.label, a.t, coalesce(coalesce(c, 0) + 0.5 * (m - coalesce(c, 0)), c) AS c FROM a LEFT JOIN (FROM m WHERE b = 1) AS n ON n.label = a.label AND n.t = a.t),
d AS (SELECT b.label, b.t, coalesce(coalesce(c, 0) + 0.5 * (m - coalesce(c, 0)), c) AS c FROM b LEFT JOIN (FROM m WHERE b = 2) AS n ON n.label = b.label AND n.t = b.t)
SELECT label, t AS i, {rr('c')} AS c FROM d
"""


@query("stream_centers", _CENTERS)
def stream_centers(spark, sf_dir):
    """Centres carried through three micro-batches."""
    v, folder = vectors(spark, sf_dir).select("sample_id", "label", "x"), scratch(spark, "centers-stream")
    state = VersionedState(spark, f"{folder}/state", "label int, center array<double>")
    for stream in _streams([v.where(F.col("sample_id") % 3 == i) for i in range(3)], folder):
        run_batches(stream, state.apply(losses.updated_centers), f"{folder}/checkpoint", "append")
    return state.last().select("label", F.posexplode("center").alias("i", "c")).select("label", "i", r("c").alias("c"))


_AVERAGES = f"""
WITH m AS (SELECT user_id, event_id % 2 AS b, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT user_id AS sample_id, {rr('coalesce(x.m + 0.25::DOUBLE * (y.m - x.m), y.m, x.m)')} AS average FROM (FROM m WHERE b = 0) AS x FULL JOIN (FROM m WHERE b = 1) AS y USING (user_id)
"""


@query("stream_averages", _AVERAGES)
def stream_averages(spark, sf_dir):
    e, folder = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), "event_id", "value"), scratch(spark, "averages-stream")
    state = VersionedState(spark, f"{folder}/state", "sample_id long, average double")
    for stream in _streams([e.where(F.col("event_id") % 2 == i) for i in range(2)], folder):
        run_batches(stream, state.apply(lambda rows, old: averaged(rows, old, "sample_id", "value", 0.25)), f"{folder}/checkpoint", "append")
    return state.last().select("sample_id", r("average").alias("average"))
