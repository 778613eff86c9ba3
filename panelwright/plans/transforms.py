"""Preprocessing, transform, mixing and imaging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import schema
from panelwright.functions.rand import sql_bits, sql_normal, sql_uniform
from panelwright.operators import imaging as I
from panelwright.operators import mixing as X
from panelwright.operators import preprocess as P
from panelwright.operators import transforms as T
from panelwright.plans.registry import query
from panelwright.plans.tables import E, Q, S, V, events_panel, quarters, r, rr, vectors


def _long(df, *keys):
    return df.select("sample_id", *keys, F.posexplode("x").alias("t", "v")).select("sample_id", *keys, "t", r("v").alias("value"))


def _panel(spark, sf_dir):
    return vectors(spark, sf_dir).select("sample_id", "var_id", "x")


def _transform(name: str, sql: str, op: str | None = None, source: str = E, **settings) -> None:
    """Query of one transform without a gate; ``sql`` gives (sample_id, t, value) from e."""

    @query(name, f"WITH {source} SELECT sample_id, t::INT AS t, {rr('value')} AS value FROM ({sql})")
    def run(spark, sf_dir):
        return _long(T.REGISTRY[op or name](_panel(spark, sf_dir), p=1, **settings))


_W = "WINDOW w AS (PARTITION BY sample_id ORDER BY t)"
_AT = "x[({})::INT + 1]"
_U = lambda op, what, *k: sql_uniform(42, f"{op}/{what}", *k)
_Z = lambda op, what, *k: sql_normal(42, f"{op}/{what}", *k)
_SER = ("sample_id", "0", "t")


@query("standardize_series", f"WITH {E} SELECT sample_id, t, {rr('(v - avg(v) OVER (PARTITION BY sample_id)) / stddev_pop(v) OVER (PARTITION BY sample_id)')} AS value FROM e")
def standardize_series(spark, sf_dir):
    return _long(P.standardize_series(_panel(spark, sf_dir)))


@query("standardize_sample", f"WITH {E}, {Q} SELECT sample_id, var_id, t, {rr('(v - avg(v) OVER (PARTITION BY sample_id)) / stddev_pop(v) OVER (PARTITION BY sample_id)')} AS value FROM q")
def standardize_sample(spark, sf_dir):
    return _long(P.standardize_samples(quarters(spark, sf_dir).select("sample_id", "var_id", "x")), "var_id")


@query("standardize_global", f"WITH {E} SELECT sample_id, t, {rr('(v - avg(v) OVER ()) / stddev_pop(v) OVER ()')} AS value FROM e")
def standardize_global(spark, sf_dir):
    return _long(P.standardize_all(_panel(spark, sf_dir)))


@query("minmax_scale", f"WITH {E} SELECT sample_id, t, {rr('(v - min(v) OVER (PARTITION BY sample_id)) / (max(v) OVER (PARTITION BY sample_id) - min(v) OVER (PARTITION BY sample_id) + 1e-8)')} AS value FROM e")
def minmax_scale(spark, sf_dir):
    return _long(P.minmax_scale(_panel(spark, sf_dir)))


@query("robust_scale", f"WITH {E} SELECT sample_id, t, {rr('(v - median(v) OVER (PARTITION BY sample_id)) / (quantile_cont(v, 0.75) OVER (PARTITION BY sample_id) - quantile_cont(v, 0.25) OVER (PARTITION BY sample_id) + 1e-8)')} AS value FROM e")
def robust_scale(spark, sf_dir):
    return _long(P.robust_scale(_panel(spark, sf_dir)))


@query("fill_missing_mean", f"WITH {E} SELECT sample_id, t, {rr('CASE WHEN t % 7 = 3 THEN avg(v) FILTER (WHERE t % 7 <> 3) OVER (PARTITION BY sample_id) ELSE v END')} AS value FROM e")
def fill_missing_mean(spark, sf_dir):
    holes = _panel(spark, sf_dir).withColumn("x", F.transform("x", lambda v, t: F.when(t % 7 == 3, float("nan")).otherwise(v)))
    return _long(P.fill_missing(holes))


@query("data_quality", f"WITH {E}, h AS (SELECT CASE WHEN t % 7 = 3 THEN NULL ELSE v END AS v FROM e) SELECT count(*) AS n_cells, count(*) - count(v) AS n_missing, 0::BIGINT AS n_infinite, min(v) AS min, max(v) AS max, {rr('avg(v)')} AS mean, {rr('stddev_pop(v)')} AS std FROM h")
def data_quality(spark, sf_dir):
    holes = _panel(spark, sf_dir).withColumn("x", F.transform("x", lambda v, t: F.when(t % 7 == 3, float("nan")).otherwise(v)))
    d = schema.data_quality(holes)
    return d.select("n_cells", "n_missing", "n_infinite", "min", "max", r("mean").alias("mean"), r("std").alias("std"))


@query("concat_panels", f"WITH {E} SELECT part, count(*) AS n, {rr('sum(v)')} AS total FROM (SELECT 'a' AS part, v FROM e WHERE sample_id % 2 = 0 UNION ALL SELECT 'b', v FROM e WHERE sample_id % 3 = 0) GROUP BY 1")
def concat_panels(spark, sf_dir):
    p = _panel(spark, sf_dir)
    both = schema.concat(p.where("sample_id % 2 = 0").withColumn("part", F.lit("a")), p.where("sample_id % 3 = 0").withColumn("part", F.lit("b")))
    return both.select("part", F.explode("x").alias("v")).groupBy("part").agg(F.count("v").alias("n"), r(F.sum("v")).alias("total"))


@query("label_encode", "SELECT event_id, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS code FROM events")
def label_encode(spark, sf_dir):
    from panelwright.plans.tables import table

    return schema.label_codes(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")


@query("transpose", f"WITH {E}, {Q} SELECT sample_id, t, {rr('sum(v * (var_id + 1))')} AS weighted FROM q GROUP BY 1, 2")
def transpose(spark, sf_dir):
    t = schema.transpose(quarters(spark, sf_dir).select("sample_id", "var_id", "x"))
    return t.select("sample_id", "t", r(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)).alias("weighted"))


@query("panel_shape", f"WITH {E}, {Q} SELECT count(DISTINCT sample_id) AS n_samples, max(var_id) + 1 AS n_vars, 16 AS seq_len FROM q")
def panel_shape(spark, sf_dir):
    return schema.shape(quarters(spark, sf_dir))


_transform("flip_time", "SELECT sample_id, 63 - t AS t, v AS value FROM e")
_transform("flip_value", "SELECT sample_id, t, -v AS value FROM e")
_transform("ts_horizontal_flip", f"SELECT sample_id, CASE WHEN {_U('ts_horizontal_flip', 'coin', 'sample_id')} < 0.5::DOUBLE THEN 63 - t ELSE t END AS t, v AS value FROM e")
_transform("vertical_flip", f"SELECT sample_id, t, CASE WHEN {_U('vertical_flip', 'coin', 'sample_id')} < 0.5::DOUBLE THEN -v ELSE v END AS value FROM e")
_transform("gaussian_noise", f"SELECT sample_id, t, v + 0.1::DOUBLE * {_Z('gaussian_noise', 'noise', *_SER)} AS value FROM e")
_transform("mag_add_noise", f"SELECT sample_id, t, v + {_Z('mag_add_noise', 'noise', *_SER)} * 0.1::DOUBLE * abs(v) AS value FROM e")
_transform("mag_mul_noise", f"SELECT sample_id, t, v * (1 + {_Z('mag_mul_noise', 'noise', *_SER)} * 0.1::DOUBLE) AS value FROM e")
_transform("mag_scale", f"SELECT sample_id, t, v * (1 / 1.2::DOUBLE + (1.2::DOUBLE - 1 / 1.2::DOUBLE) * {_U('mag_scale', 'scale')}) AS value FROM e")
_transform("mag_scale_per_var", f"SELECT sample_id, t, v * (0.8::DOUBLE + 0.4::DOUBLE * {_U('mag_scale_per_var', 'scale', 'sample_id', '0')}) AS value FROM e")
_transform("random_trend", f"SELECT sample_id, t, v + (-0.1::DOUBLE + 0.2::DOUBLE * {_U('random_trend', 'a', 'sample_id', '0')}) * t / 64 AS value FROM e")
_transform("input_dropout", f"SELECT sample_id, t, CASE WHEN {_U('input_dropout', 'cell', *_SER)} < 0.1::DOUBLE THEN 0 ELSE v END AS value FROM e")
_transform("time_step_out", f"SELECT sample_id, t, CASE WHEN {_U('time_step_out', 'step', 'sample_id', 't')} < 0.1::DOUBLE THEN coalesce(lag(v) OVER w, v) ELSE v END AS value FROM e {_W}")
_transform("self_dropout", f"SELECT sample_id, t, last_value(CASE WHEN t = 0 OR {_U('self_dropout', 'cell', *_SER)} >= 0.1::DOUBLE THEN v END IGNORE NULLS) OVER w AS value FROM e {_W}")
_CUT = "(SELECT greatest(trunc(64 * 0.2::DOUBLE * {u})::INT, 1) AS n)"
_transform("cutout", f"SELECT sample_id, t, CASE WHEN t >= s AND t < s + n THEN 0 ELSE v END AS value FROM e, (SELECT n, trunc({_U('cutout', 'start')} * (64 - n + 1))::INT AS s FROM (SELECT greatest(trunc(64 * 0.2::DOUBLE * {_U('cutout', 'length')})::INT, 1) AS n))")
_transform("time_mask", f"SELECT sample_id, t, CASE WHEN t >= s AND t < s + n THEN 0 ELSE v END AS value FROM (SELECT *, trunc({_U('time_mask', 'start0', 'sample_id')} * (64 - n + 1))::INT AS s FROM (SELECT *, trunc({_U('time_mask', 'length0', 'sample_id')} * 20)::INT AS n FROM e))", time_mask_param=20)
_transform("mask_out", f"SELECT sample_id, t, CASE WHEN rk <= greatest(round(64 * 0.2::DOUBLE * {_U('mask_out', 'ratio')}), 1) THEN 0 ELSE v END AS value FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {_U('mask_out', 'step', 'sample_id', 't')}) AS rk FROM e)")
_K = lambda op, n, key: f"(floor({_U(op, 'k', *key)} * (2 * {n} + 1)) - {n})::INT"
_transform("rotation", f"SELECT sample_id, (t + {_K('rotation', 32, ())} + 64) % 64 AS t, v AS value FROM e")
_transform("ts_random_shift", f"SELECT sample_id, (t + {_K('ts_random_shift', 32, ('sample_id',))} + 64) % 64 AS t, v AS value FROM e")
_transform("random_shift", f"SELECT e.sample_id, e.t, coalesce(f.v, 0) AS value FROM e LEFT JOIN e f ON f.sample_id = e.sample_id AND f.t = e.t - {_K('random_shift', 13, ())}")
_transform("translate_wrap", f"SELECT sample_id, (t + {_K('translate_x', 12, ())} + 64) % 64 AS t, v AS value FROM e", op="translate_x", wrap=True)
_transform("permutation", f"SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY u, t) - 1 AS t, v AS value FROM (SELECT e.*, u FROM e JOIN (SELECT i, {_U('permutation', 'segment', 'i')} AS u FROM range(5) AS q(i)) ON i = least(t // 12, 4))")
_transform("shuffle_steps", f"SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY least(t // 12, 4), {_U('shuffle_steps', 'step', 'sample_id', 't')}, t) - 1 AS t, v AS value FROM e")
_transform("moving_average", "SELECT sample_id, t, avg(v) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM e", op="smooth")
_transform("ema", "SELECT a.sample_id, a.t, CASE WHEN a.t = 0 THEN max(b.v) ELSE sum(b.v * CASE WHEN b.t = 0 THEN power(0.7::DOUBLE, a.t) ELSE 0.3::DOUBLE * power(0.7::DOUBLE, a.t - b.t) END) END AS value FROM e a JOIN e b ON a.sample_id = b.sample_id AND b.t <= a.t GROUP BY 1, 2", op="smooth", method="exponential")
_SG = "(SELECT unnest([-2, -1, 0, 1, 2]) AS k, unnest([-3, 12, 17, 12, -3]) / 35::DOUBLE AS w)"
_transform("savitzky_golay", f"SELECT a.sample_id, a.t, sum(b.v * w) / sum(abs(w)) * 47 / 35 AS value FROM e a, {_SG}, e b WHERE b.sample_id = a.sample_id AND b.t = a.t + k GROUP BY 1, 2", op="smooth", method="savitzky_golay")
_transform("blur", "SELECT a.sample_id, a.t, sum(b.v * exp(-(b.t - a.t) * (b.t - a.t) / 2)) / sum(exp(-(b.t - a.t) * (b.t - a.t) / 2)) AS value FROM e a JOIN e b ON a.sample_id = b.sample_id AND abs(a.t - b.t) <= 2 GROUP BY 1, 2")
_MA = lambda src: f"(SELECT sample_id, t, avg(v) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src})"
_transform("freq_denoise", f"SELECT sample_id, t, v AS value FROM {_MA(_MA(_MA('e')))}", op="freq_denoise", length=64)


def _resample(x: str, n: str, m: str) -> str:
    """K1 resampling of list ``x`` of length n to m steps."""
    src = f"(i * ({n} - 1) / greatest({m} - 1, 1)::DOUBLE)"
    return f"list_transform(range(0, {m}), lambda i: {x}[floor({src})::INT + 1] * (1 - ({src} - floor({src}))) + {x}[least(floor({src})::INT + 1, {n} - 1) + 1] * ({src} - floor({src})))"


_transform("down_up_scale", f"SELECT sample_id, unnest(range(64)) AS t, unnest({_resample('y', '32', '64')}) AS value FROM (SELECT sample_id, {_resample('x', '64', '32')} AS y FROM x)", source=V)
_transform("resample_steps", f"SELECT sample_id, unnest(range(64)) AS t, unnest({_resample('y', '50', '64')}) AS value FROM (SELECT sample_id, {_resample('x', '64', '50')} AS y FROM x)", source=V)
_transform("window_slice_resize", f"SELECT sample_id, unnest(range(64)) AS t, unnest({_resample('y', '57', '64')}) AS value FROM (SELECT sample_id, x[s + 1 : s + 57] AS y FROM x, (SELECT trunc({_U('window_slicing', 'start')} * 8)::INT AS s))", op="window_slicing", source=V)
_ZN = f"(SELECT greatest(trunc(64 * z)::INT, 1) AS m, z FROM (SELECT 0.5::DOUBLE + 0.3::DOUBLE * {_U('random_zoom_out', 'zoom')} AS z))"
_transform("zoom_out", f"SELECT sample_id, unnest(range(64)) AS t, unnest(list_concat(list_concat(list_transform(range(0, (64 - m) // 2), lambda i: 0::DOUBLE), {_resample('x', '64', 'm')}), list_transform(range(0, 64 - m - (64 - m) // 2), lambda i: 0::DOUBLE))) AS value FROM x, {_ZN}", op="random_zoom_out", max_zoom=0.8, source=V)
_CN = f"(SELECT m, trunc({_U('random_crop_pad', 'start')} * (64 - m + 1))::INT AS s FROM (SELECT greatest(trunc(64 * (0.5::DOUBLE + 0.5::DOUBLE * {_U('random_crop_pad', 'ratio')}))::INT, 1) AS m))"
_transform("crop_pad", f"SELECT e.sample_id, g.t, coalesce(max(e.v) FILTER (WHERE e.t = g.t - (64 - m) // 2 + s AND g.t >= (64 - m) // 2 AND g.t < (64 - m) // 2 + m), 0) AS value FROM e, (SELECT unnest(range(64)) AS t) g, {_CN} GROUP BY 1, 2", op="random_crop_pad")


def _lookup(x: str, n: int, src: str) -> str:
    p = f"greatest(0::DOUBLE, least({src}, {n - 1}::DOUBLE))"
    return f"({x}[floor({p})::INT + 1] * (1 - ({p} - floor({p}))) + {x}[least(floor({p})::INT + 1, {n - 1}) + 1] * ({p} - floor({p})))"


_MK = "[" + ", ".join(f"1 + 0.2::DOUBLE * {_Z('mag_warp', f'knot{i}')}" for i in range(4)) + "]"
_transform("mag_warp", f"SELECT sample_id, t, v * {_lookup('k', 4, '(t / 63::DOUBLE * 3)')} AS value FROM e, (SELECT {_MK} AS k)")
_TK = "[0::DOUBLE, " + ", ".join(f"(2 * {_U('time_warp', f'knot{i}')} - 1) * 0.2::DOUBLE * 64" for i in range(4)) + ", 0::DOUBLE]"
_transform("time_warp", f"SELECT sample_id, t, {_lookup('x', 64, 'src')} AS value FROM (SELECT x.sample_id, x.x, t, t + {_lookup('k', 6, '(t / 63::DOUBLE * 5)')} AS src FROM x, (SELECT unnest(range(64)) AS t), (SELECT {_TK} AS k))", source=V)


@query("resize", f"WITH {V} SELECT sample_id, t::INT AS t, {rr('value')} AS value FROM (SELECT sample_id, unnest(range(24)) AS t, unnest({_resample('x', '64', '24')}) AS value FROM x)")
def resize(spark, sf_dir):
    return _long(T.resize(_panel(spark, sf_dir), 24))


@query("haar_dwt", f"WITH {V} SELECT sample_id, i::INT AS t, {rr('(x[2 * i + 1] + x[2 * i + 2]) / sqrt(2)')} AS approx, {rr('(x[2 * i + 1] - x[2 * i + 2]) / sqrt(2)')} AS detail FROM x, range(32) AS q(i)")
def haar_dwt(spark, sf_dir):
    h = T.haar_dwt(_panel(spark, sf_dir))
    return h.select("sample_id", F.posexplode(F.arrays_zip("approx", "detail")).alias("t", "z")).select("sample_id", "t", r("z.approx").alias("approx"), r("z.detail").alias("detail"))


@query("transform_gate", f"WITH {E} SELECT sample_id, t, CASE WHEN {_U('flip_value', 'gate', 'sample_id // 100')} <= 0.5::DOUBLE THEN -v ELSE v END AS value FROM e")
def transform_gate(spark, sf_dir):
    b = _panel(spark, sf_dir).withColumn("batch_id", F.floor(F.col("sample_id") / 100))
    return T.REGISTRY["flip_value"](b, p=0.5).select("sample_id", F.posexplode("x").alias("t", "value"))


_VO = f"SELECT *, least(round(4 * 0.6::DOUBLE * {_U('var_out', 'ratio', 'sample_id')}), 3) AS n, {_U('var_out', 'var', 'sample_id', 'var_id')} AS u FROM q"


@query("var_out", f"WITH {E}, {Q}, w AS ({_VO}), k AS (SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY u) AS rk FROM w) SELECT sample_id, var_id, t, CASE WHEN rk <= n THEN 0 ELSE {rr('v')} END AS value FROM k")
def var_out(spark, sf_dir):
    q = quarters(spark, sf_dir).select("sample_id", "var_id", "x")
    v = T.REGISTRY["var_out"](q, p=1, max_drop_ratio=0.6, n_vars=4).select("sample_id", "var_id", F.posexplode("x").alias("t", "v"))
    return v.select("sample_id", "var_id", "t", F.when(F.col("v") == 0, 0.0).otherwise(r("v")).alias("value"))


_RING = lambda op, part="": f"ring AS (SELECT sample_id, label, coalesce(lead(sample_id) OVER w, first_value(sample_id) OVER w) AS partner FROM (SELECT vec_id AS sample_id, label, {sql_bits(42, op, 'vec_id')} AS b FROM embeddings) WINDOW w AS ({part} ORDER BY b, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_LAM = lambda op, a: f"(SELECT power({sql_uniform(42, op + '/u')}, 1 / {a}::DOUBLE) AS a, power({sql_uniform(42, op + '/v')}, 1 / {a}::DOUBLE) AS b)"


def _samples(spark, sf_dir):
    return vectors(spark, sf_dir).select("sample_id", "label")


@query("mixup", f"WITH {E}, {_RING('mixup')} SELECT e.sample_id, r.partner, e.t, {rr('a / (a + b) * e.v + (1 - a / (a + b)) * f.v')} AS value FROM e JOIN ring r ON r.sample_id = e.sample_id JOIN e f ON f.sample_id = r.partner AND f.t = e.t, {_LAM('mixup', 0.4)}")
def mixup(spark, sf_dir):
    return _long(X.mixup(_panel(spark, sf_dir), _samples(spark, sf_dir)), "partner")


def _cutmix_sql(op: str, part: str) -> str:
    cut = f"(SELECT c, trunc({sql_uniform(42, op + '/start')} * (64 - c + 1))::INT AS s FROM (SELECT greatest(least(round((1 - a / (a + b)) * 64), 63), 1)::INT AS c FROM {_LAM(op, 1.0)}))"
    return f"WITH {E}, {_RING(op, part)} SELECT e.sample_id, r.partner, e.t, {rr('CASE WHEN e.t >= s AND e.t < s + c THEN f.v ELSE e.v END')} AS value, {rr('1 - c / 64')} AS lam FROM e JOIN ring r ON r.sample_id = e.sample_id JOIN e f ON f.sample_id = r.partner AND f.t = e.t, {cut}"


@query("cutmix", _cutmix_sql("cutmix", ""))
def cutmix(spark, sf_dir):
    c = X.cutmix(_panel(spark, sf_dir), _samples(spark, sf_dir))
    return c.select("sample_id", "partner", F.posexplode("x").alias("t", "v"), "lam").select("sample_id", "partner", "t", r("v").alias("value"), r("lam").alias("lam"))


@query("intra_class_cutmix", _cutmix_sql("intra_cutmix", "PARTITION BY label"))
def intra_class_cutmix(spark, sf_dir):
    v = vectors(spark, sf_dir).select("sample_id", "var_id", "x")
    c = X.cutmix(v, _samples(spark, sf_dir), label="label")
    return c.select("sample_id", "partner", F.posexplode("x").alias("t", "v"), "lam").select("sample_id", "partner", "t", r("v").alias("value"), r("lam").alias("lam"))


# imaging: the first 16 steps of each series


def _cut(spark, sf_dir):
    return vectors(spark, sf_dir).select("sample_id", F.slice("x", 1, 16).alias("a"), F.slice("x", 17, 16).alias("b"))


def _cells(df, column):
    m = df.select("sample_id", F.posexplode(column).alias("i", "row")).select("sample_id", "i", F.posexplode("row").alias("j", "v"))
    return m.select("sample_id", "i", "j", r("v").alias("value"))


_D = lambda src, a, b: f"SELECT p.sample_id, p.t - {a} AS i, q.t - {b} AS j, abs(p.v - q.v) AS d FROM e p JOIN e q ON p.sample_id = q.sample_id WHERE p.t BETWEEN {a} AND {a + 15} AND q.t BETWEEN {b} AND {b + 15}"
_TH = "SELECT sample_id, i, j, (d < max(CASE WHEN rk = 25 THEN d END) OVER (PARTITION BY sample_id))::INT::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d) - 1 AS rk FROM ({}))"


@query("recurrence_plot", f"WITH {E} {_TH.format(_D('e', 0, 0))}")
def recurrence_plot(spark, sf_dir):
    return _cells(_cut(spark, sf_dir).select("sample_id", I.recurrence_plot("a").alias("m")), "m")


@query("recurrence_plot_threshold", f"WITH {E} SELECT sample_id, i, j, (d < 0.1::DOUBLE)::INT::DOUBLE AS value FROM ({_D('e', 0, 0)})")
def recurrence_plot_threshold(spark, sf_dir):
    return _cells(_cut(spark, sf_dir).select("sample_id", I.recurrence_plot("a", 0.1).alias("m")), "m")


@query("joint_recurrence", f"WITH {E}, a AS ({_TH.format(_D('e', 0, 0))}), b AS ({_TH.format(_D('e', 16, 16))}) SELECT a.sample_id, a.i, a.j, a.value * b.value AS value FROM a JOIN b USING (sample_id, i, j)")
def joint_recurrence(spark, sf_dir):
    return _cells(_cut(spark, sf_dir).select("sample_id", I.joint_recurrence("a", "b").alias("m")), "m")


@query("cross_recurrence", f"WITH {E} {_TH.format(_D('e', 0, 16))}")
def cross_recurrence(spark, sf_dir):
    return _cells(_cut(spark, sf_dir).select("sample_id", I.cross_recurrence("a", "b").alias("m")), "m")


_ANG = "a AS (SELECT sample_id, t, acos(greatest(-1, least(1, 2 * (v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-8) - 1))) AS p FROM e WHERE t < 16 WINDOW w AS (PARTITION BY sample_id))"


@query("gasf", f"WITH {E}, {_ANG} SELECT p.sample_id, p.t AS i, q.t AS j, {rr('cos(p.p + q.p)')} AS value FROM a p JOIN a q USING (sample_id)")
def gasf(spark, sf_dir):
    phi = _cut(spark, sf_dir).select("sample_id", I.angles("a").alias("phi"))
    return _cells(phi.select("sample_id", I.gasf("phi").alias("m")), "m")


@query("gadf", f"WITH {E}, {_ANG} SELECT p.sample_id, p.t AS i, q.t AS j, {rr('sin(p.p - q.p)')} AS value FROM a p JOIN a q USING (sample_id)")
def gadf(spark, sf_dir):
    phi = _cut(spark, sf_dir).select("sample_id", I.angles("a").alias("phi"))
    return _cells(phi.select("sample_id", I.gadf("phi").alias("m")), "m")


@query("ts_to_matrix", f"WITH {E}, {Q} SELECT sample_id, var_id, t, {rr('(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)')} AS value FROM q WINDOW w AS (PARTITION BY sample_id)")
def ts_to_matrix(spark, sf_dir):
    from pyspark.sql import Window

    q = quarters(spark, sf_dir)
    w = Window.partitionBy("sample_id")  # a row a variable
    b = q.withColumn("lo", F.min(F.array_min("x")).over(w)).withColumn("hi", F.max(F.array_max("x")).over(w))
    return _long(b.select("sample_id", "var_id", I.scaled_matrix("x", F.col("lo"), F.col("hi")).alias("x")), "var_id")


_MTF = """c AS (SELECT sample_id, list_sort(x[1:16]) AS o, x[1:16] AS x FROM x), b AS (SELECT sample_id, i::INT AS i, (SELECT count(*) FROM range(1, 4) AS k(k) WHERE o[round(k / 4 * 15)::INT + 1] <= x[i + 1]) AS b FROM c, range(16) AS q(i)),
s AS (SELECT p.sample_id, p.b AS f, q.b AS g, count(*) AS n FROM b p JOIN b q ON p.sample_id = q.sample_id AND q.i = p.i + 1 GROUP BY 1, 2, 3), z AS (SELECT sample_id, b, count(*) AS n FROM b WHERE i < 15 GROUP BY 1, 2)"""


@query("mtf_extension", f"WITH {V}, {_MTF} SELECT p.sample_id, p.i, q.i AS j, {rr('coalesce(s.n / z.n, 0)')} AS value FROM b p JOIN b q ON p.sample_id = q.sample_id LEFT JOIN s ON s.sample_id = p.sample_id AND s.f = p.b AND s.g = q.b LEFT JOIN z ON z.sample_id = p.sample_id AND z.b = p.b")
def mtf_extension(spark, sf_dir):
    return _cells(_cut(spark, sf_dir).select("sample_id", I.markov_transition_field("a", 4).alias("m")), "m")
