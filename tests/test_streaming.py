import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import dynamics, losses
from panelwright.streaming.dynamics import once, prediction_dynamics
from panelwright.streaming.runs import VersionedState, averaged, latest, run_batches
from panelwright.streaming.sessions import run_sessions, sessions
from panelwright.streaming.windows import windowed_features


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).alias("user"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windowed_features(stream, "user", "ts", "v", "30 minutes").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    shown = lambda df: sorted(tuple(r) for r in df.select("sample_id", "start", "end", "n", F.round("mean", 6), F.round("std", 6), "min", "max").collect())
    assert shown(spark.table("w")) == shown(windowed_features(rows, "user", "ts", "v", "30 minutes"))


def parts_stream(spark, parts, folder):
    for i, rows in enumerate(parts):
        rows.coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")


HISTORY = "sample_id long, epoch int, pred int, true_label int, confidence double, ts timestamp"


def history_rows(seed):
    rng = random.Random(seed)
    base = datetime.datetime(2024, 1, 1)
    return [(s, e, rng.randrange(3), s % 3, rng.random(), base + datetime.timedelta(minutes=e)) for s in range(6) for e in range(rng.randint(1, 9))]


@pytest.mark.parametrize("cuts", [1, 3])
def test_prediction_dynamics_of_any_cut(spark, tmp_path, cuts):
    rows = history_rows(cuts)
    random.Random(9).shuffle(rows)
    again = rows[:8] + [(s, e, 2, t, 2.0, ts) for s, e, _, t, _, ts in rows[5:9]]
    table = spark.createDataFrame(rows + again, HISTORY)
    parts = [spark.createDataFrame((rows + again)[i::cuts], HISTORY) for i in range(cuts)]
    got = latest(prediction_dynamics(parts_stream(spark, parts, tmp_path)), "sample_id", str(tmp_path))
    want = dynamics.per_sample(once(table)).withColumnRenamed("_last", "last_correct")
    names = ["sample_id", "epochs", "ever_correct", "always_correct", "flips", "first_correct", "last_incorrect", "regressed", F.round("stability", 9), F.round("mean_confidence", 9), "last_correct"]
    shown = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert shown(got) == shown(want) and got.where("closed").count() == 0


def test_idle_samples_are_closed_once(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    at = lambda s, e, minute: (s, e, 1, 1, 0.5, base + datetime.timedelta(minutes=minute))
    parts = [[at(1, 0, 0), at(2, 0, 0)], [at(1, 1, 200)], [at(1, 2, 400)]]
    made = prediction_dynamics(parts_stream(spark, [spark.createDataFrame(p, HISTORY) for p in parts], tmp_path), "ts", "1 minute", idle_seconds=6000)
    seen = []
    run_batches(made, lambda rows, i: seen.extend((i, *r) for r in rows.select("sample_id", "epochs", "closed").collect()), str(tmp_path / "c"))
    assert [x[1:] for x in seen if x[3]] == [(2, 1, True), (1, 1, True), (1, 1, True)][: len([x for x in seen if x[3]])] and (2, 1, True) in [x[1:] for x in seen]
    with pytest.raises(ValueError):
        prediction_dynamics(made, idle_seconds=1)


def test_sessions_and_late_rows(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    row = lambda u, minute, v: (u, base + datetime.timedelta(minutes=minute), v)
    kind = "user long, ts timestamp, v double"
    first = [row(1, 0, 1.0), row(1, 20, 2.0), row(2, 5, 3.0), row(1, 40, 4.0)]
    second = [row(1, 30, 5.0), row(1, 300, 6.0)]  # joins the events at 20 and 40 minutes into one session
    between = [row(1, 301, 0.5)]  # rows are late by the watermark that the batch before had
    third = [row(2, 1, 9.0), row(1, 302, 7.0)]  # the first comes after the watermark has passed its session
    mark = [row(None, 10_000, None)]
    parts = [spark.createDataFrame(p, kind) for p in (first, second, between, third, mark)]
    got, late = run_sessions(parts_stream(spark, parts, tmp_path), str(tmp_path), key="user", ts="ts", value="v", gap="15 minutes", late="30 minutes")
    found = sorted((r.sample_id, r.start, r.last, r.n, r.total) for r in got.where("sample_id IS NOT NULL").collect())
    on_time = spark.createDataFrame(first + second + between + third[1:], kind)
    want = sorted((r.sample_id, r.start, r.last, r.n, r.total) for r in sessions(on_time, "user", "ts", "v", "15 minutes").collect())
    assert found == want and len(want) == 4 and late == 1


def test_state_counts_each_batch_once_after_a_crash(spark, tmp_path):
    rows = spark.range(90).selectExpr("id % 3 AS label", "array(double(id), double(id * id)) AS x", "id")
    parts = [rows.where(f"id % 4 = {i}").select("label", "x") for i in range(4)]
    state, seen = VersionedState(spark, str(tmp_path / "state"), "label long, center array<double>"), []
    update = state.apply(losses.updated_centers)

    def failing(batch, i):
        update(batch, i)
        seen.append(i)
        if seen.count(2) == 1 and i == 2:
            raise RuntimeError("lost after the state was written")

    stream = parts_stream(spark, parts, tmp_path)
    with pytest.raises(Exception, match="lost after"):
        run_batches(stream, failing, str(tmp_path / "c"), "append")
    run_batches(stream, failing, str(tmp_path / "c"), "append")
    want = spark.createDataFrame([], state.schema)
    for p in parts:
        want = losses.updated_centers(p, want)
    assert seen == [0, 1, 2, 2, 3]
    assert sorted(map(tuple, state.last().collect())) == sorted(map(tuple, want.collect()))
    old = averaged(spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double"), spark.createDataFrame([], "k int, average double"), "k", "v")
    new = averaged(spark.createDataFrame([(1, 5.0), (3, 1.0)], "k int, v double"), old, "k", "v", 0.25)
    assert sorted(map(tuple, new.collect())) == [(1, 3.5), (2, 5.0), (3, 1.0)]


def test_dynamics_need_no_call_a_sample(spark, tmp_path):
    """Without a timer the state is an aggregate's, and a missing confidence takes no part in the mean."""
    rows = spark.createDataFrame([(1, 0, 1, 1, 0.5, None), (1, 1, 0, 1, None, None), (1, 2, 1, 1, 1.0, None), (1, 1, 2, 1, None, None)], HISTORY)
    made = prediction_dynamics(parts_stream(spark, [rows.limit(2), rows.offset(2)], tmp_path))
    assert "Pandas" not in made._jdf.queryExecution().analyzed().toString()
    got = latest(made, "sample_id", str(tmp_path)).first()
    assert (got.epochs, got.flips, got.first_correct, got.last_incorrect, got.regressed, got.stability, got.mean_confidence) == (3, 2, 0, 1, True, 0.0, 0.75)


def test_a_part_of_many_files_is_one_micro_batch(spark, tmp_path):
    from panelwright.plans.streams import _streams

    seen = []
    for stream in _streams([spark.range(50).repartition(4), spark.range(50, 80).repartition(3)], str(tmp_path)):
        run_batches(stream, lambda rows, i: seen.append((i, rows.count())), str(tmp_path / "c"), "append")
    assert seen == [(0, 50), (1, 30)]
    assert [len(list(tmp_path.glob(f"in/part={i}/*.parquet"))) for i in range(2)] == [4, 3]
