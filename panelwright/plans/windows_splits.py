"""Window and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.rand import sql_bits
from panelwright.operators import splits as P
from panelwright.operators import windows as W
from panelwright.plans.registry import query
from panelwright.plans.tables import S, events_panel, r, rr, vectors

_EV = "p AS (SELECT sample_id, list(v ORDER BY t) AS x, count(*) AS n FROM e GROUP BY 1)"
_SUM = lambda c: f"coalesce({rr(f'list_sum({c})')}, 0)"


def _digest(df, *arrays):
    return df.select("sample_id", "start", *[F.coalesce(r(F.aggregate(a, F.lit(0.0), lambda s, v: s + v)), F.lit(0.0)).alias(f"{a}_sum") for a in arrays])


def _sliding_sql(w, s, h):
    return f"WITH {S}, {_EV} SELECT sample_id, i::INT AS start, {_SUM(f'x[i + 1 : i + {w}]')} AS window_sum, {_SUM(f'x[i + {w} + 1 : i + {w + h}]')} AS target_sum FROM p, unnest(range(0, n - {w + h} + 1, {s})) AS u(i) WHERE n >= {w + h}"


@query("sliding_windows", _sliding_sql(16, 8, 4))
def sliding_windows(spark, sf_dir):
    return _digest(W.sliding_windows(events_panel(spark, sf_dir), 16, 8, 4), "window", "target")


@query("sliding_windows_horizon", _sliding_sql(20, 5, 10))
def sliding_windows_horizon(spark, sf_dir):
    return _digest(W.sliding_windows(events_panel(spark, sf_dir), 20, 5, 10), "window", "target")


@query("forecast_windows", _sliding_sql(24, 6, 6))
def forecast_windows(spark, sf_dir):
    return _digest(W.forecast_windows(events_panel(spark, sf_dir), 24, 6), "window", "target")


@query("sliding_windows_keep_tail", f"""WITH {S}, {_EV}, u AS (SELECT *, ((n - 20) // 8 + 1) * 8 AS last FROM p), i AS (SELECT sample_id, x, n, i FROM u, unnest(range(0, CASE WHEN n >= last + 16 THEN last + 1 ELSE n - 19 END, 8)) AS q(i))
SELECT sample_id, i::INT AS start, {_SUM("x[i + 1 : i + 16]")} AS window_sum, {_SUM("x[i + 17 : i + 20]")} AS target_sum FROM i""")
def sliding_windows_keep_tail(spark, sf_dir):
    return _digest(W.sliding_windows(events_panel(spark, sf_dir), 16, 8, 4, drop_incomplete=False), "window", "target")


@query("patches", f"WITH {S}, {_EV} SELECT sample_id, (i // 6)::INT AS patch_id, {_SUM('x[i + 1 : i + 12]')} AS patch_sum FROM p, unnest(range(0, n - 12 + 1, 6)) AS u(i)")
def patches(spark, sf_dir):
    p = W.patches(events_panel(spark, sf_dir), 12, 6)
    return p.select("sample_id", "patch_id", r(F.aggregate("patch", F.lit(0.0), lambda s, v: s + v)).alias("patch_sum"))


@query("forecast_holdout", f"WITH {S}, {_EV} SELECT sample_id, (n - 10)::INT AS n_train, {_SUM('x[1 : n - 10]')} AS train_sum, {_SUM('x[n - 9 : n]')} AS test_sum FROM p")
def forecast_holdout(spark, sf_dir):
    h = W.forecast_holdout(events_panel(spark, sf_dir), 10)
    add = lambda c: r(F.aggregate(c, F.lit(0.0), lambda s, v: s + v))
    return h.select("sample_id", F.size("train").alias("n_train"), add("train").alias("train_sum"), add("test").alias("test_sum"))


@query("pad_post", f"WITH {S}, {_EV} SELECT sample_id, (SELECT max(n) FROM p)::INT AS length, {_SUM('x')} AS total, ((SELECT max(n) FROM p) - n)::INT AS added FROM p")
def pad_post(spark, sf_dir):
    panel = events_panel(spark, sf_dir).withColumn("n", F.size("x"))
    out = W.pad_sequences(panel, value=0.0)
    return out.select("sample_id", F.size("x").alias("length"), r(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).alias("total"), (F.size("x") - F.col("n")).alias("added"))


@query("truncate_min", f"WITH {S}, {_EV} SELECT sample_id, (SELECT min(n) FROM p)::INT AS length, {_SUM('x[1 : (SELECT min(n) FROM p)]')} AS total FROM p")
def truncate_min(spark, sf_dir):
    out = W.truncate_to_shortest(events_panel(spark, sf_dir))
    return out.select("sample_id", F.size("x").alias("length"), r(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).alias("total"))


def _rows(spark, sf_dir):
    return vectors(spark, sf_dir).select("sample_id", "label")


_R = "t AS (SELECT vec_id AS sample_id, label, row_number() OVER (ORDER BY {}, vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)"
_SHUF = _R.format(sql_bits(42, "split", "vec_id"))
_ORD = _R.format("vec_id")


@query("random_split", f"WITH {_SHUF} SELECT sample_id, label, CASE WHEN k < round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM t")
def random_split(spark, sf_dir):
    return P.random_split(_rows(spark, sf_dir), 0.2)


@query("random_split3", f"WITH {_SHUF} SELECT sample_id, label, CASE WHEN k < round(n * 0.2::DOUBLE) THEN 'test' WHEN k < round(n * 0.2::DOUBLE) + round(n * 0.15::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM t")
def random_split3(spark, sf_dir):
    return P.random_split3(_rows(spark, sf_dir), 0.15, 0.2)


@query("time_split", f"WITH {_ORD} SELECT sample_id, label, CASE WHEN k < round(n * 0.7::DOUBLE) THEN 'train' WHEN k < round(n * 0.7::DOUBLE) + round(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM t")
def time_split(spark, sf_dir):
    return P.time_split(_rows(spark, sf_dir), 0.7, 0.15)


@query("time_split_gap", f"WITH {_ORD}, g AS (SELECT *, round(n * 0.6::DOUBLE) AS a, round(n * 0.2::DOUBLE) AS b FROM t) SELECT sample_id, label, CASE WHEN k < a THEN 'train' WHEN k < a + 5 + b THEN 'valid' ELSE 'test' END AS split FROM g WHERE k < a OR (k >= a + 5 AND k < a + 5 + b) OR k >= a + b + 10")
def time_split_gap(spark, sf_dir):
    return P.time_split(_rows(spark, sf_dir), 0.6, 0.2, 5)


def _fold_sql(expanding: bool) -> str:
    start = "0" if expanding else "greatest(100 + f * ((n - 102) // 4), 0) - 100"
    return f"WITH {_ORD}, f AS (SELECT f, n, 102 + f * ((n - 102) // 4) AS ts, {start} AS a FROM range(4) AS q(f), (SELECT count(*) AS n FROM embeddings)) SELECT t.sample_id, t.label, f.f::INT AS fold, CASE WHEN t.k >= f.ts THEN 'test' ELSE 'train' END AS part FROM t JOIN f ON (t.k >= f.a AND t.k < f.ts - 2) OR (t.k >= f.ts AND t.k < f.ts + 50)"


@query("walk_forward_expanding", _fold_sql(True))
def walk_forward_expanding(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return P.walk_forward_folds(rows, P.walk_forward(rows.count(), 4, 100, 50, 2))


@query("walk_forward_sliding", _fold_sql(False))
def walk_forward_sliding(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return P.walk_forward_folds(rows, P.walk_forward(rows.count(), 4, 100, 50, 2, expanding=False))


_C = "c AS (SELECT vec_id AS sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {}, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query("stratified_split", f"WITH {_C.format(sql_bits(42, 'class', 'vec_id'))} SELECT sample_id, label, CASE WHEN k < floor(n * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM c")
def stratified_split(spark, sf_dir):
    return P.stratified_split(_rows(spark, sf_dir))


@query("limited_labels", f"WITH {_C.format(sql_bits(42, 'class', 'vec_id'))} SELECT sample_id, label, CASE WHEN k < greatest(floor(n * 0.1::DOUBLE), 1) THEN 'labelled' ELSE 'unlabelled' END AS split FROM c")
def limited_labels(spark, sf_dir):
    return P.limited_labels(_rows(spark, sf_dir), 0.1)


@query("stratified_sampler", f"WITH {_C.format(sql_bits(42, 'stratified', 'vec_id'))} SELECT sample_id, label, k AS class_rank FROM c")
def stratified_sampler(spark, sf_dir):
    return P.stratified_order(_rows(spark, sf_dir))


@query("batches", f"WITH {_R.format(sql_bits(42, 'batch', 'vec_id'))} SELECT sample_id, label, k // 32 AS batch_id FROM t")
def batches(spark, sf_dir):
    return P.batches(_rows(spark, sf_dir), 32, shuffle=True)


_PAIR = """
WITH p AS (SELECT vec_id AS sample_id, CASE WHEN vec_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, {bits} AS o FROM embeddings)
SELECT sample_id, split, ((row_number() OVER (ORDER BY o, sample_id) - 1) // 32)::BIGINT AS batch_id FROM p WHERE split = 'train'
UNION ALL SELECT sample_id, split, ((row_number() OVER (ORDER BY sample_id) - 1) // 64)::BIGINT FROM p WHERE split = 'valid'
"""


@query("loader_pair", _PAIR.format(bits=sql_bits(42, "batch", "vec_id")))
def loader_pair(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("sample_id", F.when(F.col("sample_id") % 5 == 0, "valid").otherwise("train").alias("split"))
    train, valid = P.loaders(rows)
    return train.unionByName(valid)


@query("batches_drop_last", f"WITH {_ORD} SELECT sample_id, label, k // 32 AS batch_id FROM t WHERE k // 32 < n // 32")
def batches_drop_last(spark, sf_dir):
    return P.batches(_rows(spark, sf_dir), 32, drop_last=True)


@query("hard_examples", "WITH t AS (SELECT vec_id AS sample_id, vec_id // 32 AS batch_id, embedding[1]::DOUBLE AS loss FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY loss DESC, sample_id) AS k, count(*) OVER (PARTITION BY batch_id) AS n FROM t) SELECT sample_id, batch_id, loss FROM k WHERE k <= greatest(round(n * 0.25::DOUBLE), 1)")
def hard_examples(spark, sf_dir):
    v = vectors(spark, sf_dir).select("sample_id", F.floor(F.col("sample_id") / 32).alias("batch_id"), F.get("x", F.lit(0)).alias("loss"))
    return P.batch_subsample(v, 0.25, "hard")
