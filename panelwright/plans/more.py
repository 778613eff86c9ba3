"""Further queries: transforms with draws of several kinds, kernel features, tables of a training run, attributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelwright import schema
from panelwright.functions.rand import sql_bits, sql_normal, sql_uniform
from panelwright.operators import calibration, dynamics, explain, losses, metrics, rocket, schedules, search
from panelwright.operators import mixing as X
from panelwright.operators import transforms as T
from panelwright.plans.registry import query
from panelwright.plans.tables import E, L, Q, S, V, events_long, logits, quarters, r, rr, table, vectors
from panelwright.plans.transforms import _SER, _U, _long, _lookup, _panel, _resample, _transform

# transforms


def _short(x: str, n: str, m: str) -> str:
    """Resampling of list ``x`` of length n to m steps that never reaches the last value."""
    src = f"(i / {m} * ({n} - 1))"
    return f"list_transform(range(0, {m}), lambda i: {x}[floor({src})::INT + 1] * (1 - ({src} - floor({src}))) + {x}[least(floor({src})::INT + 1, {n} - 1) + 1] * ({src} - floor({src})))"


def _back(n: str, name: str, op: str | None = None, **settings) -> None:
    """Resampled to ``n`` steps and back."""
    _transform(name, f"SELECT sample_id, unnest(range(64)) AS t, unnest({_resample('y', 'n', '64')}) AS value FROM (SELECT sample_id, n, {_resample('x', '64', 'n')} AS y FROM x, (SELECT {n} AS n))", op=op, source=V, **settings)


_transform("uniform_noise", f"SELECT sample_id, t, v + 0.1::DOUBLE * (2 * {_U('uniform_noise', 'noise', *_SER)} - 1) AS value FROM e")
_transform("time_noise", f"SELECT x.sample_id, t, {_lookup('x', 64, '(t + (2 * ' + _U('time_noise', 'step', 'sample_id', 't') + ' - 1) * 6)')} AS value FROM x, (SELECT unnest(range(64)) AS t)", source=V)
_back(f"greatest(trunc(64 * (0.8::DOUBLE + 0.4::DOUBLE * {_U('random_size', 'ratio')}))::INT, 2)", "random_size")
_back(f"greatest(trunc(64 * (0.8::DOUBLE + 0.4::DOUBLE * {_U('resize_back', 'ratio')}))::INT, 2)", "resize_back")
_back(f"greatest(trunc(64 / (0.8::DOUBLE + 0.4::DOUBLE * {_U('random_time_scale', 'scale')}))::INT, 2)", "random_time_scale")
_back(f"greatest(trunc(64 * (0.3::DOUBLE + 0.4::DOUBLE * {_U('random_low_res', 'scale')}))::INT, 2)", "random_low_res")
_STEP = f"(SELECT trunc(2 + floor({_U('random_time_step', 'k')} * 3))::INT AS k)"
_transform("random_time_step", f"SELECT sample_id, unnest(range(64)) AS t, unnest({_resample('y', 'len(y)', '64')}) AS value FROM (SELECT sample_id, list_transform(range(0, 64, k), lambda i: x[i + 1]) AS y FROM x, {_STEP})", source=V, min_step=2, max_step=4)
_CROP = f"SELECT sample_id, x, n, trunc({_U('random_resized_crop', 'start', 'sample_id')} * (64 - n + 1))::INT AS s FROM (SELECT *, greatest(trunc(64 * (0.5::DOUBLE + 0.5::DOUBLE * {_U('random_resized_crop', 'ratio', 'sample_id')}))::INT, 1) AS n FROM x)"
_transform("random_resized_crop", f"SELECT sample_id, unnest(range(64)) AS t, unnest({_short('y', 'n', '64')}) AS value FROM (SELECT sample_id, n, x[s + 1 : s + n] AS y FROM ({_CROP}))", source=V)
_WARP = f"(SELECT s, greatest(trunc(6 * scale)::INT, 1) AS m FROM (SELECT trunc({_U('window_warp', 'start')} * 59)::INT AS s, [0.5::DOUBLE, 2.0::DOUBLE][trunc({_U('window_warp', 'scale')} * 2)::INT + 1] AS scale))"
_transform("window_warp", f"SELECT sample_id, unnest(range(64)) AS t, unnest({_short('z', 'len(z)', '64')}) AS value FROM (SELECT sample_id, list_concat(list_concat(x[1:s], {_short('w', '6', 'm')}), x[s + 7 : 64]) AS z FROM (SELECT *, x[s + 1 : s + 6] AS w FROM x, {_WARP}))", source=V)
_RAW = f"SELECT sample_id, t, v, 2 * {_U('random_freq_noise', 'noise', *_SER)} - 1 AS raw FROM e"
_transform("random_freq_noise", f"SELECT sample_id, t, v + (raw - avg(raw) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) * 0.1::DOUBLE * stddev_pop(v) OVER (PARTITION BY sample_id) AS value FROM ({_RAW})")
_SIZE = f"k AS (SELECT sample_id, [3, 5, 7][trunc({_U('random_conv', 'size', 'sample_id', '0')} * 3)::INT + 1] AS k FROM x)"
_WEIGHT = f"w AS (SELECT sample_id, k, j, w / sum(w) OVER (PARTITION BY sample_id) AS w FROM (SELECT sample_id, k, j, {_U('random_conv', 'weight', 'sample_id', '0', 'j')} + 0.1::DOUBLE AS w FROM k, range(7) AS q(j) WHERE j < k))"
_CONV = "y AS (SELECT x.sample_id, t, sum(w.w * x.x[greatest(least(t + j - k // 2, 63), 0) + 1]) AS y, max(x.x[t + 1]) AS v FROM x JOIN w USING (sample_id), range(64) AS p(t) GROUP BY 1, 2)"
_transform("random_conv", "SELECT sample_id, t, y + (avg(v) OVER (PARTITION BY sample_id) - avg(y) OVER (PARTITION BY sample_id)) AS value FROM y", source=f"{V}, {_SIZE}, {_WEIGHT}, {_CONV}")


def _over_vars(name: str, sql: str, op) -> None:
    """Query of a transform of four variables; ``sql`` gives (sample_id, var_id, t, value) from q."""

    @query(name, f"WITH {E}, {Q} SELECT sample_id, var_id, t::INT AS t, {rr('value')} AS value FROM ({sql})")
    def run(spark, sf_dir):
        return _long(op(quarters(spark, sf_dir).select("sample_id", "var_id", "x")), "var_id")


def _vars_masked(source: str) -> str:
    """frequency_mask over four variables of at most three."""
    cut = f"SELECT *, trunc({_U('frequency_mask', 'start0', 'sample_id')} * (4 - n + 1))::INT AS s FROM (SELECT *, trunc({_U('frequency_mask', 'length0', 'sample_id')} * 3)::INT AS n FROM {source})"
    return f"SELECT sample_id, var_id, t, CASE WHEN var_id >= s AND var_id < s + n THEN 0 ELSE v END AS value FROM ({cut})"


_over_vars("frequency_mask", _vars_masked("q"), lambda df: T.REGISTRY["frequency_mask"](df, p=1, n_vars=4, freq_mask_param=3))
_u43 = lambda what: sql_uniform(43, f"time_mask/{what}", "sample_id")
_over_vars(
    "spec_augment",
    f"SELECT sample_id, var_id, t, CASE WHEN t >= s AND t < s + n THEN 0 ELSE value END AS value FROM (SELECT *, trunc({_u43('start0')} * (16 - n + 1))::INT AS s FROM (SELECT *, trunc({_u43('length0')} * 8)::INT AS n FROM ({_vars_masked('q')})))",
    lambda df: T.spec_augment(df, n_vars=4, freq_mask_param=3, time_mask_param=8),
)
_MOVED = lambda what, var: f"SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY {_U('shuffle_highs_lows', what, 'sample_id', 't')}, t) - 1 AS t, v FROM q WHERE var_id = {var}"
_over_vars(
    "shuffle_highs_lows",
    f"SELECT sample_id, var_id, t, v AS value FROM q WHERE var_id NOT IN (1, 2) UNION ALL SELECT sample_id, k, h.t, CASE WHEN k = 1 THEN greatest(h.v, l.v) ELSE least(h.v, l.v) END FROM ({_MOVED('high', 1)}) h JOIN ({_MOVED('low', 2)}) l USING (sample_id, t), (SELECT unnest([1, 2]) AS k)",
    T.shuffle_highs_lows,
)


@query("rand_augment", f"WITH {E}, k AS (SELECT sample_id, ((t + (floor({_U('rotation', 'k')} * 33) - 16)::INT + 64) % 64)::INT AS t, v FROM e) SELECT sample_id, t, {rr('v + ' + sql_normal(43, 'mag_add_noise/noise', *_SER) + ' * 0.1::DOUBLE * abs(v)')} AS value FROM k")
def rand_augment(spark, sf_dir):
    return _long(T.rand_augment(_panel(spark, sf_dir), 2, 0.5))


@query("compose", f"WITH {E} SELECT sample_id, 63 - t::INT AS t, {rr('-v')} AS value FROM e")
def compose(spark, sf_dir):
    return _long(T.compose(_panel(spark, sf_dir), [T.identity, lambda d: T.REGISTRY["flip_value"](d, p=1), lambda d: T.REGISTRY["flip_time"](d, p=1)]))


@query("mix_strategy", f"WITH {E}, {{ring}} SELECT e.sample_id, r.partner, e.t, {rr('a / (a + b) * e.v + (1 - a / (a + b)) * f.v')} AS value FROM e JOIN ring r ON r.sample_id = e.sample_id JOIN e f ON f.sample_id = r.partner AND f.t = e.t, {{lam}}".format(
    ring="ring AS (SELECT sample_id, coalesce(lead(sample_id) OVER w, first_value(sample_id) OVER w) AS partner FROM (SELECT vec_id AS sample_id, {} AS b FROM embeddings) WINDOW w AS (ORDER BY b, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))".format(sql_bits(7, "mixup", "vec_id")),
    lam=f"(SELECT power({sql_uniform(7, 'mixup/u')}, 1 / 0.4::DOUBLE) AS a, power({sql_uniform(7, 'mixup/v')}, 1 / 0.4::DOUBLE) AS b)",
))
def mix_strategy(spark, sf_dir):
    return _long(X.mix(_panel(spark, sf_dir), vectors(spark, sf_dir).select("sample_id", "label"), "mixup", 0.4, seed=7), "partner")


# kernel features


def _kernel_sql(bank, source: str, length: int, pooled: str, fitted: bool = False, keys: str = "sample_id") -> str:
    """Features of a kernel bank in SQL: the bank is a table of taps, a convolution a sum over them. ``pooled`` is a list made of y (output), on (above the bias) and n (outputs)."""
    taps = ", ".join(f"({k}, {i * d - p}, {float(w[i])!r}::DOUBLE)" for k, (w, _, d, p) in enumerate(bank) for i in range(len(w)))
    sizes = ", ".join(f"({k}, {b!r}::DOUBLE, {max(length + 2 * p - (len(w) - 1) * d, 0)})" for k, (w, b, d, p) in enumerate(bank))
    bias = "SELECT k, median(y) AS bias FROM y WHERE sample_id IN (SELECT DISTINCT sample_id FROM y ORDER BY sample_id LIMIT 100) GROUP BY k" if fitted else "SELECT k, bias FROM s"
    return f"""s(k, bias, n) AS (VALUES {sizes}), w(k, off, w) AS (VALUES {taps}),
y AS MATERIALIZED (SELECT {keys}, s.k, s.n, z.t - w.off AS p, sum(w.w * z.v) AS y FROM {source} z, w JOIN s USING (k) WHERE z.t - w.off BETWEEN 0 AND s.n - 1 GROUP BY ALL),
b AS ({bias}), o AS (SELECT y.*, y > bias AS onn, p - row_number() OVER (PARTITION BY {keys}, y.k, y > bias ORDER BY p) AS run FROM y JOIN b USING (k)),
l AS (SELECT {keys}, k, max(c) AS longest FROM (SELECT {keys}, k, run, count(*) AS c FROM o WHERE onn GROUP BY ALL) GROUP BY ALL),
f AS (SELECT {keys}, o.k, {pooled} AS f FROM o LEFT JOIN l USING ({keys}, k) GROUP BY {keys}, o.k)
SELECT {keys}, (k * len(f) + i)::INT AS i, {rr('f[i + 1]')} AS value FROM f, range(4) AS q(i) WHERE i < len(f)"""


_PPV = "avg(onn::INT)"
_POOLED = {
    "minirocket": f"[{_PPV}]", "rocket": f"[max(y), {_PPV}]",
    "multirocket": f"[{_PPV}, coalesce(avg(y) FILTER (WHERE onn), 0), coalesce(avg(p / n) FILTER (WHERE onn), 0.5), coalesce(max(longest), 0) / max(n)]",
}


def _kernel_query(name: str, bank: list, fitted: bool = False) -> None:
    @query(name, f"WITH {E}, {_kernel_sql(bank, 'e', 64, _POOLED[name], fitted)}")
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        f = rocket.extract(v, rocket.fit_bank(v, bank) if fitted else bank, name)
        return f.select("sample_id", F.posexplode("features").alias("i", "v")).select("sample_id", "i", r("v").alias("value"))


_kernel_query("minirocket", rocket.minirocket_bank(168, 64))
_kernel_query("rocket", rocket.rocket_bank(100, 64), fitted=True)
_kernel_query("multirocket", rocket.minirocket_bank(84, 64), fitted=True)
_GROUPS = rocket.hydra_groups(2, 8, size=5)
_HYDRA = [(w, 0.0, 2**g, 0) for g, b in enumerate(_GROUPS) for w in b]


def _hydra(name: str, pooled: str, op) -> None:
    @query(name, f"WITH {E}, {Q}, {_kernel_sql(_HYDRA, 'q', 16, pooled, keys='sample_id, var_id')}")
    def run(spark, sf_dir):
        f = op(quarters(spark, sf_dir).select("sample_id", "var_id", "x"), _GROUPS)
        return f.select("sample_id", "var_id", F.posexplode("features").alias("i", "v")).select("sample_id", "var_id", "i", r("v").alias("value"))


_hydra("hydra", f"[max(y), avg(y), {_PPV}]", rocket.hydra)
_hydra("hydra_multirocket", _POOLED["multirocket"], rocket.hydra_multirocket)

# tables of a training run


def _preds(spark, sf_dir):
    p = calibration.from_logits(logits(spark, sf_dir))
    return p.withColumn("loss", losses.cross_entropy("logits", "label"))


_SOFT = f"WITH {E}, {L}, s AS (SELECT sample_id, any_value(label) AS label, max(exp(z)) / sum(exp(z)) AS prob, arg_max(c, z) AS pred, ln(sum(exp(z))) - max(z) FILTER (WHERE c = label) AS loss FROM l GROUP BY 1)"


@query("class_stats", f"{_SOFT} SELECT label, count(*) AS n, {rr('avg((label = pred)::INT)')} AS accuracy, {rr('avg(prob)')} AS mean_confidence, {rr('avg(loss)')} AS mean_loss FROM s GROUP BY 1")
def class_stats(spark, sf_dir):
    s = metrics.class_stats(_preds(spark, sf_dir))
    return s.select("label", "n", *[r(c).alias(c) for c in ("accuracy", "mean_confidence", "mean_loss")])


@query("binary_scores", f"""{_SOFT}, b AS (SELECT (label > 4)::INT AS y, (pred > 4)::INT AS p FROM s), c AS (SELECT sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, count(*) AS n, sum((y = p)::INT) AS ok FROM b),
d AS (SELECT ok / n AS accuracy, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall FROM c) SELECT {rr('accuracy')} AS accuracy, {rr('precision')} AS precision, {rr('recall')} AS recall, {rr('2 * precision * recall / (precision + recall + 1e-8)')} AS f1 FROM d""")
def binary_scores(spark, sf_dir):
    p = _preds(spark, sf_dir).selectExpr("int(label > 4) AS label", "int(pred > 4) AS pred")
    return metrics.binary_scores(p).select(*[r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("well_calibrated", f"{_SOFT}, b AS (SELECT least(floor(prob * 10), 9) AS b, count(*) AS n, abs(avg(prob) - avg((label = pred)::INT)) AS gap FROM s GROUP BY 1), e2 AS (SELECT sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM b) SELECT {rr('ece')} AS ece, {rr('mce')} AS mce, ece < 0.05 AS well_calibrated FROM e2")
def well_calibrated(spark, sf_dir):
    return calibration.is_well_calibrated(_preds(spark, sf_dir)).select(r("ece").alias("ece"), r("mce").alias("mce"), "well_calibrated")


@query("label_cardinality", f"WITH {E}, m AS (SELECT sample_id, sum((v > 0)::INT)::DOUBLE AS n FROM e WHERE t < 5 GROUP BY 1) SELECT min(n) AS min, max(n) AS max, {rr('avg(n)')} AS mean FROM m")
def label_cardinality(spark, sf_dir):
    y = F.transform(F.slice("x", 1, 5), lambda v: (v > 0).cast("double"))
    return metrics.label_cardinality(vectors(spark, sf_dir).select("sample_id", y.alias("y"))).select("min", "max", r("mean").alias("mean"))


@query("label_frequency", f"WITH {E} SELECT t::INT AS label, sum((v > 0)::INT)::DOUBLE AS n, {rr('avg((v > 0)::INT) * 100')} AS percent FROM e WHERE t < 5 GROUP BY 1")
def label_frequency(spark, sf_dir):
    y = F.transform(F.slice("x", 1, 5), lambda v: (v > 0).cast("double"))
    return metrics.label_frequency(vectors(spark, sf_dir).select("sample_id", y.alias("y"))).select("label", "n", r("percent").alias("percent"))


_CENTERS = "c AS (SELECT label, t, avg(v) AS c FROM e WHERE label < 8 GROUP BY 1, 2)"


@query("center_plus", f"WITH {E}, {L}, {_CENTERS}, d AS (SELECT e.sample_id, sum((v - coalesce(c, 0)) * (v - coalesce(c, 0))) / 2 AS d FROM e LEFT JOIN c USING (label, t) GROUP BY 1), s AS (SELECT sample_id, ln(sum(exp(z))) - max(z) FILTER (WHERE c = label) AS ce FROM l GROUP BY 1) SELECT sample_id, {rr('ce + 0.003::DOUBLE * d')} AS loss FROM s JOIN d USING (sample_id)")
def center_plus(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("logits", F.slice("x", 1, 10))
    means = v.where("label < 8").select("label", F.posexplode("x").alias("t", "v")).groupBy("label", "t").agg(F.avg("v").alias("m"))
    centers = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "m"))), lambda s: s["m"]).alias("center"))
    return losses.center_plus(v, centers).select("sample_id", r("loss").alias("loss"))


_RUN = "h AS (SELECT event_type AS run_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::INT AS epoch, value AS valid_loss FROM events)"


def _history(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), k.alias("epoch"), F.col("value").alias("valid_loss"))


@query("best_epoch", f"WITH {_RUN} SELECT epoch, {rr('valid_loss')} AS value FROM h WHERE run_id = (SELECT min(run_id) FROM h) ORDER BY valid_loss, epoch LIMIT 1")
def best_epoch(spark, sf_dir):
    h = _history(spark, sf_dir)
    return dynamics.best_epoch(h.where(F.col("run_id") == h.agg(F.min("run_id")).first()[0])).select("epoch", r("value").alias("value"))


@query("early_stopping", f"""WITH {_RUN}, k AS (SELECT *, valid_loss < coalesce(min(valid_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS better FROM h),
l AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS last FROM k) SELECT run_id, min(CASE WHEN epoch - last >= 10 THEN epoch END)::BIGINT AS stop_epoch FROM l GROUP BY 1""")
def early_stopping(spark, sf_dir):
    return dynamics.early_stopping(_history(spark, sf_dir), 10)


@query("terminate_on_nan", f"WITH {_RUN} SELECT run_id, min(epoch) FILTER (WHERE epoch % 17 = 16 AND valid_loss > 20)::BIGINT AS stop_epoch FROM h GROUP BY 1")
def terminate_on_nan(spark, sf_dir):
    """Runs whose loss is NaN at some epochs stop at the first of them, whatever the patience."""
    broken = F.when((F.col("epoch") % 17 == 16) & (F.col("valid_loss") > 20), F.lit(float("nan"))).otherwise(F.col("valid_loss"))
    return dynamics.early_stopping(_history(spark, sf_dir).withColumn("valid_loss", broken), 10**9)


def _steps(spark, sf_dir):
    """Runs and their steps: a user's events in order of time."""
    return events_long(spark, sf_dir).select(F.col("sample_id").alias("run_id"), F.col("t").alias("step"))


_STEPS = f"WITH {S}, s AS (SELECT sample_id AS run_id, t AS step FROM e)"


@query("curriculum_share", _STEPS + " SELECT run_id, step AS epoch, round(0.2::DOUBLE + 0.8::DOUBLE * least(step / 9, 1), 6) AS share FROM s")
def curriculum_share(spark, sf_dir):
    return _steps(spark, sf_dir).select("run_id", F.col("step").alias("epoch"), F.round(dynamics.curriculum_share(F.col("step"), 10), 6).alias("share"))


@query("constant_schedule", _STEPS + " SELECT run_id, step, 0.01::DOUBLE AS lr FROM s")
def constant_schedule(spark, sf_dir):
    return _steps(spark, sf_dir).withColumn("lr", schedules.constant(F.col("step"), 0.01))


@query("linear_warmup", _STEPS + f" SELECT run_id, step, {rr('CASE WHEN step < 10 THEN 0.001::DOUBLE + 0.009::DOUBLE * step / 10 ELSE 0.01::DOUBLE * power(0.9::DOUBLE, step - 10) END', 9)} AS lr FROM s")
def linear_warmup(spark, sf_dir):
    s = F.col("step")
    return _steps(spark, sf_dir).withColumn("lr", r(schedules.linear_warmup(s, 10, 0.001, schedules.exponential(s - 10, 0.01, 0.9), 0.01), 9))


_ENCODED = "CASE WHEN var_id % 2 = 0 THEN sin(t / power(10000::DOUBLE, 2 * (var_id // 2) / 4)) ELSE cos(t / power(10000::DOUBLE, 2 * (var_id // 2) / 4)) END"


@query("positional_encoding", f"WITH {E}, {Q} SELECT sample_id, var_id, t, {rr('v + ' + _ENCODED)} AS value FROM q")
def positional_encoding(spark, sf_dir):
    """The encoding of each step added to the series, a variable a dimension."""
    added = lambda v, t: v + schedules.positional_encoding(t, F.col("var_id"), 4)
    return _long(quarters(spark, sf_dir).withColumn("x", F.transform("x", added)), "var_id")


def _trials(spark, sf_dir, points: list[dict], names: list[str]):
    """Mean squared error over the panel of each trial, which predicts a series' second value as ``lr`` first + 0.01 ``depth``; all trials in one pass."""
    trials = F.array(*[F.struct(F.lit(i).alias("trial_id"), *[F.lit(p[n]).alias(n) for n in names]) for i, p in enumerate(points)])
    v = vectors(spark, sf_dir).select(F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), F.explode(trials).alias("p"))
    error = F.col("p.lr") * F.col("a") + 0.01 * F.col("p.depth") - F.col("b")
    return v.groupBy("p.trial_id", *[f"p.{n}" for n in names]).agg(r(F.avg(error * error)).alias("score"))


_SCORE = rr("avg((lr * embedding[1]::DOUBLE + 0.01::DOUBLE * depth - embedding[2]::DOUBLE) ** 2)")
_GRID = "SELECT unnest([0.1::DOUBLE, 0.01::DOUBLE, 0.001::DOUBLE]) AS lr), (SELECT unnest([1, 2, 3]) AS depth)"


@query("hpo_grid", f"SELECT lr, depth, {_SCORE} AS score FROM embeddings, ({_GRID} GROUP BY lr, depth")
def hpo_grid(spark, sf_dir):
    return _trials(spark, sf_dir, search.grid({"lr": [0.1, 0.01, 0.001], "depth": [1, 2, 3]}), ["lr", "depth"]).drop("trial_id")


_DRAWN = sql_uniform(42, "X", "i").replace("42:X", "42")
_LOG = f"exp({math.log(1e-4)!r}::DOUBLE + {_DRAWN.replace('::VARCHAR)', '::VARCHAR || {name})')} * {math.log(1e-1) - math.log(1e-4)!r}::DOUBLE)".replace("{name}", "':lr'")
_DEPTH = "1 + floor(" + _DRAWN.replace("::VARCHAR)", "::VARCHAR || ':depth')") + " * 5)::INT"


@query("random_search", f"SELECT trial_id, {rr('lr', 9)} AS lr, depth, {_SCORE} AS score FROM embeddings, (SELECT i::INT AS trial_id, {_LOG} AS lr, {_DEPTH} AS depth FROM range(50) AS q(i)) GROUP BY trial_id, lr, depth")
def random_search(spark, sf_dir):
    points = search.random_points({"lr": ("log", 1e-4, 1e-1), "depth": (1, 5)}, 50)
    return _trials(spark, sf_dir, points, ["lr", "depth"]).withColumn("lr", r("lr", 9))


# panels


@query("stack_variables", f"WITH {E} SELECT sample_id, (t // 32)::INT AS var_id, (t % 32)::INT AS t, {rr('v')} AS value FROM e")
def stack_variables(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _long(schema.stack_variables([v.select("sample_id", F.slice("x", 1 + 32 * i, 32).alias("x")) for i in range(2)]), "var_id")


@query("mixed_input", f"WITH {E} SELECT sample_id, max(label) AS label, {rr('sum(v)')} AS total FROM e GROUP BY 1")
def mixed_input(spark, sf_dir):
    v = vectors(spark, sf_dir)
    m = schema.mixed_input(v.select("sample_id", "var_id", "x"), v.select("sample_id", "label"))
    return m.select("sample_id", "label", r(F.aggregate("x", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("labelled_union", f"{_SOFT} SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN label ELSE pred END AS label, CASE WHEN sample_id % 2 = 0 THEN 1 ELSE {rr('prob')} END AS weight FROM s")
def labelled_union(spark, sf_dir):
    p = _preds(spark, sf_dir)
    known = p.where("sample_id % 2 = 0").select("sample_id", "label")
    both = schema.labelled_union(known, p.select("sample_id", "pred", F.col("prob").alias("weight")))
    return both.select("sample_id", "label", F.when(F.col("sample_id") % 2 == 0, F.col("weight")).otherwise(r("weight")).alias("weight"))


@query("filled", "SELECT vec_id AS sample_id, v::INT AS var_id, t::INT AS t, 1::DOUBLE AS value FROM embeddings, range(2) AS a(v), range(3) AS b(t)")
def filled(spark, sf_dir):
    p = schema.filled(vectors(spark, sf_dir), 2, 3, 1.0)
    return p.select("sample_id", "var_id", F.posexplode("x").alias("t", "value"))


@query("class_count", "SELECT count(DISTINCT label) AS n FROM embeddings")
def class_count(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return spark.createDataFrame([(schema.class_count(v.where("sample_id % 2 = 0"), v.where("sample_id % 2 = 1")),)], "n long")


@query("image_channels", f"WITH {E} SELECT sample_id, c::INT AS channel, p.t AS i, q.t AS j, {rr('CASE WHEN c = 0 THEN p.v * q.v ELSE p.v - q.v END')} AS value FROM e p JOIN e q USING (sample_id), range(2) AS k(c) WHERE p.t < 4 AND q.t < 4")
def image_channels(spark, sf_dir):
    x = F.slice("x", 1, 4)
    image = lambda f: F.transform(x, lambda a: F.transform(x, lambda b: f(a, b)))
    both = vectors(spark, sf_dir).select("sample_id", schema.channels({"product": image(lambda a, b: a * b), "difference": image(lambda a, b: a - b)}).alias("c"))
    rows = both.select("sample_id", F.posexplode("c").alias("channel", "m")).select("sample_id", "channel", F.posexplode("m").alias("i", "row"))
    return rows.select("sample_id", "channel", "i", F.posexplode("row").alias("j", "v")).select("sample_id", "channel", "i", "j", r("v").alias("value"))


@query("select_rows", f"WITH {E} SELECT pos, e.sample_id, e.t::INT AS t, {rr('v')} AS value FROM e JOIN (SELECT i AS pos, (i * 7) % 20 AS k FROM range(30) AS q(i)) ON sample_id = (SELECT min(sample_id) FROM e) + k WHERE t < 4")
def select_rows(spark, sf_dir):
    """Rows by a list of ids in its order, some twice."""
    v = vectors(spark, sf_dir).select("sample_id", "var_id", F.slice("x", 1, 4).alias("x"))
    first = v.agg(F.min("sample_id")).first()[0]
    index = spark.range(30).select(F.col("id").alias("pos"), ((F.col("id") * 7) % 20 + F.lit(first)).alias("sample_id"))
    return _long(schema.select_rows(v, index), "pos")


@query("long_to_panel", f"WITH {S} SELECT sample_id, count(*)::INT AS n, {rr('sum(v * (t + 1))', 4)} AS weighted FROM e GROUP BY 1")
def long_to_panel(spark, sf_dir):
    p = schema.to_panel(events_long(spark, sf_dir).withColumn("var_id", F.lit(0)))
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return p.select("sample_id", F.size("x").alias("n"), r(weighted, 4).alias("weighted"))


@query("panel_to_long", f"WITH {E}, {Q} SELECT sample_id, var_id, t, {rr('v')} AS value FROM q")
def panel_to_long(spark, sf_dir):
    rows = schema.to_long(quarters(spark, sf_dir).select("sample_id", "var_id", "x"))
    return rows.select("sample_id", "var_id", "t", r("value").alias("value"))


@query("panel_numel", f"WITH {E}, {Q} SELECT count(*) AS cells, true AS compatible FROM q")
def panel_numel(spark, sf_dir):
    q = quarters(spark, sf_dir)
    return schema.numel(q).crossJoin(schema.compatible(q.where("sample_id % 2 = 0"), q.where("sample_id % 2 = 1")))


_MIX = "ring AS (SELECT sample_id, label, coalesce(lead(sample_id) OVER w, first_value(sample_id) OVER w) AS partner FROM (SELECT vec_id AS sample_id, label, {} AS b FROM embeddings) WINDOW w AS (ORDER BY b, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query("mix_labels", f"WITH {_MIX.format(sql_bits(42, 'mixup', 'vec_id'))}, p AS (SELECT a / (a + b) AS l FROM (SELECT power({sql_uniform(42, 'mixup/u')}, 1 / 0.4::DOUBLE) AS a, power({sql_uniform(42, 'mixup/v')}, 1 / 0.4::DOUBLE) AS b)) SELECT r.sample_id, c::INT AS class, {rr('l * (r.label = c)::INT + (1 - l) * (o.label = c)::INT')} AS y FROM ring r JOIN ring o ON o.sample_id = r.partner, p, range(10) AS k(c)")
def mix_labels(spark, sf_dir):
    v = vectors(spark, sf_dir)
    mixed = X.mix_labels(X.mixup(v.select("sample_id", "var_id", "x"), v.select("sample_id", "label")), v.select("sample_id", "label"), 10)
    return mixed.select("sample_id", F.posexplode("y").alias("class", "y")).select("sample_id", "class", r("y").alias("y"))


# attributions: the second half of a vector stands for the gradient of the first


def _attributed(spark, sf_dir):
    q = quarters(spark, sf_dir).select("sample_id", "var_id", "x")
    g = q.where("var_id >= 2").select("sample_id", (F.col("var_id") - 2).alias("var_id"), F.col("x").alias("g"))
    return q.where("var_id < 2").join(g, ["sample_id", "var_id"]).select("sample_id", "var_id", explain.input_x_gradient("x", "g").alias("attribution"))


_ATT = f"WITH {E}, {Q}, a AS (SELECT x.sample_id, x.var_id, x.t, abs(x.v * g.v) AS a FROM q x JOIN q g ON g.sample_id = x.sample_id AND g.t = x.t AND g.var_id = x.var_id + 2)"


@query("input_x_gradient", f"{_ATT} SELECT sample_id, var_id, t, {rr('CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END')} AS value FROM a WINDOW w AS (PARTITION BY sample_id)")
def input_x_gradient(spark, sf_dir):
    a = explain.normalised(_attributed(spark, sf_dir), ["sample_id"])
    return a.select("sample_id", "var_id", F.posexplode("attribution").alias("t", "v")).select("sample_id", "var_id", "t", r("v").alias("value"))


@query("attribution_by_variable", f"{_ATT} SELECT var_id, {rr('avg(a)')} AS mean FROM a GROUP BY 1")
def attribution_by_variable(spark, sf_dir):
    return explain.mean_by_variable(_attributed(spark, sf_dir)).select("var_id", r("mean").alias("mean"))


@query("attribution_by_step", f"{_ATT} SELECT t, {rr('avg(a)')} AS mean FROM a GROUP BY 1")
def attribution_by_step(spark, sf_dir):
    return explain.mean_by_step(_attributed(spark, sf_dir)).select("t", r("mean").alias("mean"))


@query("normal_baseline", f"SELECT vec_id AS sample_id, t::INT AS t, {rr(sql_normal(42, 'baseline', 'vec_id', '0', 't'))} AS value FROM embeddings, range(64) AS q(t)")
def normal_baseline(spark, sf_dir):
    b = vectors(spark, sf_dir).select("sample_id", explain.normal_baseline("x").alias("b"))
    return b.select("sample_id", F.posexplode("b").alias("t", "v")).select("sample_id", "t", r("v").alias("value"))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Which of two columns a rule depends on, with the deviation over shuffles."""
    df = vectors(spark, sf_dir).select("sample_id", "label", F.get("x", F.lit(0)).alias("a"), F.col("label").cast("double").alias("b"))
    score = lambda d: metrics.evaluate(d.select("label", F.col("b").cast("int").alias("pred"))).first().accuracy
    return spark.createDataFrame(explain.permutation_importance(df, ["a", "b"], score, repeats=2), "column string, mean double, deviation double")
