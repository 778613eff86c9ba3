"""Prediction dynamics of a stream of predictions, with the history of each sample as keyed state.

A sample's state holds its epochs seen so far (a few numbers an epoch), so an epoch that comes late takes its place
and a repeated one counts once; each micro-batch gives a row for every sample it touches, which equals that of
``operators.dynamics.per_sample`` over all epochs so far. Whatever the cut into micro-batches, a sample's last row
is the same. The state is that of an aggregate, the set of a sample's epochs: of an epoch that comes with different
values all are kept and the greatest counts. With ``idle_seconds``, a sample that has had no epoch for so long (in event
time) gets a last row, marked ``closed``, and its state goes; this needs a timer and calls Python once a sample and
micro-batch, at some milliseconds each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelwright.functions.arrays import let, pairs

OUT = "sample_id long, epochs long, ever_correct boolean, always_correct boolean, flips long, first_correct int, last_incorrect int, regressed boolean, stability double, mean_confidence double, last_correct boolean, closed boolean"
STATE = "epochs array<long>, preds array<int>, labels array<int>, confidences array<double>, seen long"


def once(history: DataFrame) -> DataFrame:
    """One row for each (sample_id, epoch); of different ones that with the greatest (pred, true_label, confidence)."""
    best = F.max(F.struct("pred", "true_label", "confidence")).alias("_b")
    return history.groupBy("sample_id", "epoch").agg(best).select("sample_id", "epoch", "_b.*")


def row_of(sample_id: int, known: dict[int, tuple], closed: bool) -> pd.DataFrame:
    """The dynamics of one sample; ``known``: epoch -> (pred, true_label, confidence)."""
    rows = [known[e] for e in sorted(known)]
    pred = np.array([p for p, _, _ in rows])
    right = np.array([p == t for p, t, _ in rows])
    flips = int((pred[1:] != pred[:-1]).sum())
    wrong_at, right_at = np.nonzero(~right)[0], np.nonzero(right)[0]
    was = np.concatenate([[False], np.logical_or.accumulate(right)[:-1]])
    return pd.DataFrame([{
        "sample_id": sample_id, "epochs": len(rows), "ever_correct": bool(right.any()), "always_correct": bool(right.all()), "flips": flips,
        "first_correct": int(right_at[0]) if len(right_at) else None, "last_incorrect": int(wrong_at[-1]) if len(wrong_at) else None, "regressed": bool((~right & was).any()),
        "stability": 1.0 if len(rows) < 2 else 1 - flips / (len(rows) - 1), "mean_confidence": float(np.mean([c for _, _, c in rows])), "last_correct": bool(right[-1]), "closed": closed,
    }]).astype({"first_correct": "Int32", "last_incorrect": "Int32"})


def rows_of(known: DataFrame) -> DataFrame:
    """The same of each row (sample_id, known), with ``known`` an array of (epoch, pred, true_label, confidence), by array expressions."""
    newest = lambda z: F.filter(z, lambda v, i: ~v["epoch"].eqNullSafe(F.get(z, i + 1)["epoch"]) | (i + 1 == F.size(z)))
    k = known.select("sample_id", let(F.array_sort("known"), newest).alias("k"))
    k = k.withColumn("right", F.transform("k", lambda v: v["pred"] == v["true_label"]))
    k = k.withColumns({"sure": F.filter("right", lambda v: v.isNotNull()), "given": F.filter(F.col("k")["confidence"], lambda c: c.isNotNull()), "n": F.size("k").cast("long")})
    flips = F.size(F.filter(pairs(F.col("k")["pred"], 1, lambda a, b: a != b), lambda v: v)).cast("long")
    first, last = F.array_position("right", True), F.array_position(F.reverse("right"), False)
    k = k.withColumns({"flips": flips, "first_correct": F.when(first > 0, first - 1).cast("int"), "last_incorrect": F.when(last > 0, F.col("n") - last).cast("int")})
    any_sure = F.size("sure") > 0
    return k.select(
        "sample_id", F.col("n").alias("epochs"), F.when(any_sure, F.array_contains("sure", True)).alias("ever_correct"), F.when(any_sure, ~F.array_contains("sure", False)).alias("always_correct"), "flips",
        "first_correct", "last_incorrect", F.coalesce(F.col("last_incorrect") > F.col("first_correct"), F.lit(False)).alias("regressed"), F.when(F.col("n") < 2, 1.0).otherwise(1 - F.col("flips") / (F.col("n") - 1)).alias("stability"),
        F.when(F.size("given") > 0, F.aggregate("given", F.lit(0.0), lambda s, v: s + v) / F.size("given")).alias("mean_confidence"), F.get("sure", F.size("sure") - 1).alias("last_correct"), F.lit(False).alias("closed"),
    )


def prediction_dynamics(history: DataFrame, time: str | None = None, late: str = "10 minutes", idle_seconds: float | None = None) -> DataFrame:
    """Updates by sample of a stream (sample_id, epoch, pred, true_label, confidence).

    ``idle_seconds`` needs ``time``, the column of event time, whose watermark trails by ``late``; rows behind it are left out.
    """
    if idle_seconds is not None and time is None:
        raise ValueError("closing idle samples needs a time column")
    values = [F.col(c).cast(kind).alias(c) for c, kind in (("epoch", "long"), ("pred", "int"), ("true_label", "int"), ("confidence", "double"))]
    if idle_seconds is None:
        return rows_of(history.groupBy(F.col("sample_id").cast("long").alias("sample_id")).agg(F.collect_set(F.struct(*values)).alias("known")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epochs, preds, labels, confidences, seen = state.get if state.exists else ([], [], [], [], 0)
        known = dict(zip(epochs, zip(preds, labels, confidences, strict=True), strict=True))
        if state.hasTimedOut:
            state.remove()
            yield row_of(key[0], known, True)
            return
        for batch in batches:
            for e, p, t, c, at in zip(batch["epoch"].tolist(), batch["pred"].tolist(), batch["true_label"].tolist(), batch["confidence"].tolist(), batch["at"].tolist(), strict=True):
                known[e] = max(known.get(e, (p, t, c)), (p, t, c))
                seen = max(seen, at)
        order = sorted(known)
        state.update((order, *([known[e][i] for e in order] for i in range(3)), seen))
        state.setTimeoutTimestamp(max(int(seen + 1000 * idle_seconds), state.getCurrentWatermarkMs() + 1))
        yield row_of(key[0], known, False)

    rows = history.withWatermark(time, late) if history.isStreaming else history
    rows = rows.select(F.col("sample_id").cast("long"), *values, F.unix_millis(time).alias("at"), time)
    return rows.groupBy("sample_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
