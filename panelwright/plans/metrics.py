"""Metric, calibration, loss, dynamics and schedule queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from panelwright.functions import arrays as A
from panelwright.operators import calibration as C
from panelwright.operators import dynamics as D
from panelwright.operators import losses as Z
from panelwright.operators import metrics as M
from panelwright.operators import schedules as H
from panelwright.plans.registry import query
from panelwright.plans.tables import E, K, L, P, S, events_long, logits, r, rounded, rr, table, vectors


def _preds(spark, sf_dir):
    return C.from_logits(logits(spark, sf_dir)).select("sample_id", "label", "pred", "prob", "probs", "logits")


_CM = f"WITH {E}, {K}, c AS (SELECT label, pred, count(*) AS n FROM k GROUP BY 1, 2), g AS (SELECT a::INT AS label, b::INT AS pred, coalesce(n, 0) AS n FROM range(10) AS x(a), range(10) AS y(b) LEFT JOIN c ON c.label = a AND c.pred = b)"
_PC = _CM + ", s AS (SELECT label AS class, sum(n) AS support, sum(n) FILTER (WHERE label = pred) AS hit FROM g GROUP BY 1), q AS (SELECT pred AS class, sum(n) AS predicted FROM g GROUP BY 1), m AS (SELECT class, support, predicted, hit, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM s JOIN q USING (class)), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)"


@query("confusion_matrix", _CM + " SELECT label, pred, n::BIGINT AS n FROM g")
def confusion_matrix(spark, sf_dir):
    return M.confusion_grid(_preds(spark, sf_dir), 10).select("label", "pred", "n")


@query("confusion_normalized", _CM + f" SELECT label, pred, CASE WHEN n > 0 THEN {rr('n / t')} ELSE 0 END AS share FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM g)")
def confusion_normalized(spark, sf_dir):
    return M.confusion_grid(_preds(spark, sf_dir), 10).select("label", "pred", F.when(F.col("share") > 0, r("share")).otherwise(0.0).alias("share"))


@query("classification_report", _PC + f" SELECT class, {rr('p')} AS precision, {rr('r')} AS recall, {rr('f1')} AS f1, support::BIGINT AS support FROM f")
def classification_report(spark, sf_dir):
    return M.per_class(_preds(spark, sf_dir)).select("class", *[r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("report_averages", _PC + f" SELECT {rr('sum(hit) / sum(support)')} AS accuracy, {rr('avg(p)')} AS macro_precision, {rr('avg(r)')} AS macro_recall, {rr('avg(f1)')} AS macro_f1, {rr('sum(f1 * support) / sum(support)')} AS weighted_f1, sum(support)::BIGINT AS support FROM f WHERE support > 0")
def report_averages(spark, sf_dir):
    return M.report(_preds(spark, sf_dir)).select(*[r(c).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")], "support")


@query("macro_f1", _PC + f" SELECT {rr('avg(f1) FILTER (WHERE support > 0)')} AS f1_in_labels, {rr('avg(r) FILTER (WHERE support > 0)')} AS recall_in_labels, {rr('avg(p) FILTER (WHERE predicted > 0)')} AS precision_in_predictions, {rr('sum(f1) / 10')} AS f1_all_classes FROM f")
def macro_f1(spark, sf_dir):
    m = M.macro_scores(_preds(spark, sf_dir), 10)
    return m.select(*[r(c).alias(c) for c in m.columns])


@query("extreme_classes", _PC + " SELECT (SELECT class FROM f WHERE support > 0 ORDER BY f1, class LIMIT 1) AS worst, (SELECT class FROM f WHERE support > 0 ORDER BY f1 DESC, class DESC LIMIT 1) AS best")
def extreme_classes(spark, sf_dir):
    return M.extreme_classes(_preds(spark, sf_dir))


@query("mcc_multiclass", _PC + f" SELECT {rr('(sum(hit) * sum(support) - sum(support * predicted)) / sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted * predicted)) * (sum(support)::DOUBLE * sum(support) - sum(support * support)))')} AS mcc FROM f")
def mcc_multiclass(spark, sf_dir):
    return M.mcc(_preds(spark, sf_dir)).select(r("mcc").alias("mcc"))


@query("auc_binary", f"WITH a AS (SELECT toxic = 1 AS positive, (doc_id % 17)::DOUBLE AS score FROM labels), k AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM a) SELECT {rr('(sum(rk) FILTER (WHERE positive) - count(*) FILTER (WHERE positive) * (count(*) FILTER (WHERE positive) + 1) / 2) / (count(*) FILTER (WHERE positive) * count(*) FILTER (WHERE NOT positive))')} AS auc FROM k")
def auc_binary(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("positive"), (F.col("doc_id") % 17).cast("double").alias("score"))
    return M.auc(a).select(r("auc").alias("auc"))


@query("auc_ovr", f"WITH {E}, {P}, k AS (SELECT c, label = c AS positive, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2 AS rk FROM p), a AS (SELECT c, (sum(rk) FILTER (WHERE positive) - count(*) FILTER (WHERE positive) * (count(*) FILTER (WHERE positive) + 1) / 2) / (count(*) FILTER (WHERE positive) * count(*) FILTER (WHERE NOT positive)) AS auc FROM k GROUP BY c) SELECT {rr('avg(auc)')} AS auc FROM a")
def auc_ovr(spark, sf_dir):
    return M.auc_one_vs_rest(_preds(spark, sf_dir)).select(r("auc").alias("auc"))


def _pairs(spark, sf_dir):
    return vectors(spark, sf_dir).select("sample_id", F.get("x", F.lit(0)).alias("pred"), F.get("x", F.lit(1)).alias("target"))


_PAIR = "t AS (SELECT vec_id AS sample_id, embedding[1]::DOUBLE AS pred, embedding[2]::DOUBLE AS target FROM embeddings)"


@query("regression_metrics", f"WITH {_PAIR} SELECT {rr('avg((pred - target) * (pred - target))')} AS mse, {rr('avg(abs(pred - target))')} AS mae, {rr('sqrt(avg((pred - target) * (pred - target)))')} AS rmse, {rr('1 - sum((pred - target) * (pred - target)) / (var_pop(target) * count(*) + 1e-8)')} AS r2, 1.0::DOUBLE AS valid_fraction FROM t")
def regression_metrics(spark, sf_dir):
    return M.regression(_pairs(spark, sf_dir)).select(*[r(c).alias(c) for c in ("mse", "mae", "rmse", "r2")], "valid_fraction")


@query("mape", f"WITH {_PAIR} SELECT {rr('avg(abs(pred - target) / abs(target)) * 100', 4)} AS mape FROM t WHERE abs(target) > 0.05")
def mape(spark, sf_dir):
    return M.regression(_pairs(spark, sf_dir), eps=0.05).select(r("mape", 4).alias("mape"))


@query("target_stats", f"WITH {_PAIR} SELECT min(target) AS min, max(target) AS max, {rr('avg(target)')} AS mean, {rr('stddev_pop(target)')} AS std FROM t")
def target_stats(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(F.min("target").alias("min"), F.max("target").alias("max"), r(F.avg("target")).alias("mean"), r(F.stddev_pop("target")).alias("std"))


_B = f"WITH {E}, {K}, b AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg(conf) AS confidence, avg((pred = label)::INT) AS accuracy FROM k GROUP BY 1)"


@query("calibration_bins", _B + f", a AS (SELECT i::INT AS bin, coalesce(n, 0) AS n, coalesce(confidence, (i + 0.5::DOUBLE) / 10) AS confidence, coalesce(accuracy, (i + 0.5::DOUBLE) / 10) AS accuracy FROM range(10) AS q(i) LEFT JOIN b ON bin = i) SELECT bin, n, {rounded('confidence accuracy')} FROM a")
def calibration_bins(spark, sf_dir):
    return C.all_bins(_preds(spark, sf_dir)).select("bin", "n", r("confidence").alias("confidence"), r("accuracy").alias("accuracy"))


@query("ece_mce", _B + f" SELECT {rr('sum(abs(accuracy - confidence) * n) / sum(n)')} AS ece, {rr('max(abs(accuracy - confidence))')} AS mce FROM b")
def ece_mce(spark, sf_dir):
    return C.errors(_preds(spark, sf_dir)).select(r("ece").alias("ece"), r("mce").alias("mce"))


@query("leaning_bins", _B + f" SELECT bin, n, {rr('confidence - accuracy')} AS gap, CASE WHEN confidence - accuracy > 0 THEN 'over' ELSE 'under' END AS kind FROM b WHERE abs(confidence - accuracy) > 0.01::DOUBLE")
def leaning_bins(spark, sf_dir):
    return C.leaning_bins(_preds(spark, sf_dir)).select("bin", "n", r(F.col("confidence") - F.col("accuracy")).alias("gap"), "kind")


@query("temperature_softmax", f"WITH {E}, {L} SELECT sample_id, c AS class, {rr('exp((z - m) / 2) / sum(exp((z - m) / 2)) OVER (PARTITION BY sample_id)')} AS p FROM (SELECT *, max(z) OVER (PARTITION BY sample_id) AS m FROM l)")
def temperature_softmax(spark, sf_dir):
    p = logits(spark, sf_dir).select("sample_id", F.posexplode(A.softmax("logits", 2.0)).alias("class", "p"))
    return p.select("sample_id", "class", r("p").alias("p"))


@query("optimal_temperature", f"""WITH {E}, {L}, g AS (SELECT i, 0.5::DOUBLE + 4.5::DOUBLE * i / 19 AS t FROM range(20) AS q(i)), m AS (SELECT *, max(z) OVER (PARTITION BY sample_id) AS m FROM l),
w AS (SELECT i, t, sample_id, label, c, exp((z - m) / t) / sum(exp((z - m) / t)) OVER (PARTITION BY i, sample_id) AS p FROM m, g), k AS (SELECT i, t, label, arg_max(c, p) AS pred, max(p) AS conf FROM w GROUP BY i, t, sample_id, label),
b AS (SELECT i, t, least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg((pred = label)::INT) AS a FROM k GROUP BY 1, 2, 3), e2 AS (SELECT i, t, sum(abs(a - c) * n) / sum(n) AS ece FROM b GROUP BY 1, 2)
SELECT {rr('t')} AS temperature, {rr('ece')} AS ece FROM e2 ORDER BY e2.ece, i LIMIT 1""")
def optimal_temperature(spark, sf_dir):
    return C.optimal_temperature(logits(spark, sf_dir)).select(r("temperature").alias("temperature"), r("ece").alias("ece"))


_CE = f"WITH {E}, {L}, s AS (SELECT sample_id, label, c, z - m - ln(sum(exp(z - m)) OVER (PARTITION BY sample_id)) AS ls FROM (SELECT *, max(z) OVER (PARTITION BY sample_id) AS m FROM l)), y AS (SELECT sample_id, label, ls FROM s WHERE c = label)"


@query("cross_entropy", _CE + f" SELECT sample_id, {rr('-ls')} AS loss FROM y")
def cross_entropy(spark, sf_dir):
    return logits(spark, sf_dir).select("sample_id", r(Z.cross_entropy("logits", "label")).alias("loss"))


@query("focal", _CE + f" SELECT sample_id, {rr('-0.25 * power(1 - exp(ls), 2) * ls')} AS loss FROM y")
def focal(spark, sf_dir):
    return logits(spark, sf_dir).select("sample_id", r(Z.focal("logits", "label", 2.0, 0.25)).alias("loss"))


@query("label_smoothing", _CE + f" SELECT sample_id, {rr('-sum(ls * CASE WHEN c = label THEN 0.9::DOUBLE ELSE 0.1::DOUBLE / 9 END)')} AS loss FROM s GROUP BY 1")
def label_smoothing(spark, sf_dir):
    return logits(spark, sf_dir).select("sample_id", r(Z.label_smoothing("logits", "label")).alias("loss"))


def _pair_loss(name, sql, column):
    @query(name, f"WITH {_PAIR} SELECT sample_id, {rr(sql)} AS loss FROM t")
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("sample_id", r(column()).alias("loss"))


_pair_loss("huber", "CASE WHEN abs(pred - target) <= 1 THEN (pred - target) * (pred - target) / 2 ELSE abs(pred - target) - 0.5::DOUBLE END", lambda: Z.huber("pred", "target"))
_pair_loss("log_cosh", "abs(pred - target) + ln(1 + exp(-2 * abs(pred - target))) - ln(2)", lambda: Z.log_cosh("pred", "target"))
_pair_loss("mse_loss", "(pred - target) * (pred - target)", lambda: Z.squared("pred", "target"))
_MU = "greatest(exp(pred), 1e-8)"
_pair_loss("tweedie", f"greatest(target, 0) * 2 / sqrt({_MU}) + 2 * sqrt({_MU})", lambda: Z.tweedie("pred", "target"))
_pair_loss("tweedie_deviance", f"2 * (-4 * sqrt(greatest(target, 0)) + greatest(target, 0) * 2 / sqrt({_MU}) + 2 * sqrt({_MU}))", lambda: Z.tweedie_deviance("pred", "target"))


@query("masked_loss", f"WITH {_PAIR} SELECT {rr('avg((pred - target) * (pred - target)) FILTER (WHERE sample_id % 3 <> 0)')} AS mse, {rr('avg(abs(pred - target) + ln(1 + exp(-2 * abs(pred - target))) - ln(2)) FILTER (WHERE sample_id % 3 <> 0)')} AS log_cosh FROM t")
def masked_loss(spark, sf_dir):
    t = _pairs(spark, sf_dir).withColumn("target", F.when(F.col("sample_id") % 3 == 0, float("nan")).otherwise(F.col("target")))
    return t.agg(r(Z.masked_mean(Z.squared("pred", "target"), "pred", "target")).alias("mse"), r(Z.masked_mean(Z.log_cosh("pred", "target"), "pred", "target")).alias("log_cosh"))


@query("center_update", f"WITH {E} SELECT label, t AS i, {rr('0.5 * avg(v)')} AS c FROM e GROUP BY 1, 2")
def center_update(spark, sf_dir):
    v = vectors(spark, sf_dir)
    none = spark.createDataFrame([], "label int, center array<double>")
    c = Z.updated_centers(v, none)
    return c.select("label", F.posexplode("center").alias("i", "c")).select("label", "i", r("c").alias("c"))


@query("center_loss", f"WITH {E}, c AS (SELECT label, t, 0.5 * avg(v) AS c FROM e GROUP BY 1, 2) SELECT sample_id, {rr('sum((v - c) * (v - c)) / 2')} AS loss FROM e JOIN c USING (label, t) GROUP BY 1")
def center_loss(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = Z.updated_centers(v, spark.createDataFrame([], "label int, center array<double>"))
    return Z.center_loss(v, c).select("sample_id", r("center_loss").alias("loss"))


_T = f"WITH {E}, {K}"


@query("top_losses", _CE + f" SELECT sample_id, {rr('-ls')} AS loss FROM y ORDER BY -ls DESC, sample_id LIMIT 20")
def top_losses(spark, sf_dir):
    s = logits(spark, sf_dir).select("sample_id", Z.cross_entropy("logits", "label").alias("loss"))
    return M.top_losses(s, 20).select("sample_id", r("loss").alias("loss"))


@query("common_confusions", _T + f", c AS (SELECT label, pred, count(*) AS n FROM k WHERE label <> pred GROUP BY 1, 2) SELECT label, pred, n, {rr('n / (SELECT sum(n) FROM c)')} AS share FROM c ORDER BY c.n DESC, label, pred LIMIT 10")
def common_confusions(spark, sf_dir):
    return M.common_confusions(_preds(spark, sf_dir)).select("label", "pred", "n", r("share").alias("share"))


@query("errors_by_class", _T + f" SELECT label, count(*) FILTER (WHERE label <> pred) AS errors, count(*) AS total, {rr('count(*) FILTER (WHERE label <> pred) / count(*)')} AS rate FROM k GROUP BY 1")
def errors_by_class(spark, sf_dir):
    return M.errors_by_class(_preds(spark, sf_dir)).select("label", "errors", "total", r("rate").alias("rate"))


@query("difficulty_buckets", _T + " SELECT CASE WHEN label = pred AND conf >= 0.9 THEN 'easy' WHEN label <> pred OR conf < 0.6 THEN 'hard' ELSE 'medium' END AS bucket, count(*) AS n FROM k GROUP BY 1")
def difficulty_buckets(spark, sf_dir):
    return M.difficulty(_preds(spark, sf_dir)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_H = "h AS (SELECT sample_id, t AS epoch, CASE WHEN v < 30 THEN 0 WHEN v < 60 THEN 1 ELSE 2 END AS pred, sample_id % 3 AS true_label, 1 / (1 + v / 100) AS confidence FROM e)"


def history(spark, sf_dir):
    v = F.col("value")
    e = events_long(spark, sf_dir)
    return e.select("sample_id", F.col("t").alias("epoch"), F.when(v < 30, 0).when(v < 60, 1).otherwise(2).alias("pred"), (F.col("sample_id") % 3).cast("int").alias("true_label"), (1 / (1 + v / 100)).alias("confidence"))


DYNAMICS_SQL = f"""WITH {S}, {_H}, w AS (SELECT *, pred = true_label AS ok, (lag(pred) OVER o <> pred)::INT AS flip, bool_or(pred = true_label) OVER (PARTITION BY sample_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM h WINDOW o AS (PARTITION BY sample_id ORDER BY epoch)),
d AS (SELECT sample_id, count(*) AS epochs, bool_or(ok) AS ever_correct, bool_and(ok) AS always_correct, coalesce(sum(flip), 0)::BIGINT AS flips, min(epoch) FILTER (WHERE ok) AS first_correct, max(epoch) FILTER (WHERE NOT ok) AS last_incorrect, coalesce(bool_or(NOT ok AND was), false) AS regressed, 1 - coalesce(sum(flip), 0) / greatest(count(*) - 1, 1) AS stability, avg(confidence) AS mean_confidence, arg_max(ok, epoch) AS last FROM w GROUP BY 1)"""


@query("prediction_flips", DYNAMICS_SQL + f" SELECT sample_id, epochs, flips, {rounded('stability mean_confidence')} FROM d")
def prediction_flips(spark, sf_dir):
    return D.per_sample(history(spark, sf_dir)).select("sample_id", "epochs", "flips", r("stability").alias("stability"), r("mean_confidence").alias("mean_confidence"))


@query("prediction_regressions", DYNAMICS_SQL + " SELECT sample_id, ever_correct, always_correct, regressed, first_correct::INT AS first_correct, last_incorrect::INT AS last_incorrect FROM d")
def prediction_regressions(spark, sf_dir):
    return D.per_sample(history(spark, sf_dir)).select("sample_id", "ever_correct", "always_correct", "regressed", F.col("first_correct").cast("int").alias("first_correct"), F.col("last_incorrect").cast("int").alias("last_incorrect"))


@query("difficulty_scores", DYNAMICS_SQL + f" SELECT sample_id, {rr('(coalesce(first_correct / (SELECT max(epochs) FROM d), 1) + 1 - stability + CASE WHEN last THEN 0 ELSE 0.5::DOUBLE END) / 3')} AS difficulty FROM d")
def difficulty_scores(spark, sf_dir):
    h = history(spark, sf_dir)
    return D.difficulty_scores(h, h.agg(F.max("epoch")).first()[0] + 1).select("sample_id", r("difficulty").alias("difficulty"))


@query("dynamics_summary", DYNAMICS_SQL + f" SELECT count(*) AS samples, count(*) FILTER (WHERE NOT ever_correct) AS never_correct, count(*) FILTER (WHERE always_correct) AS always_correct, count(*) FILTER (WHERE regressed) AS regressed, count(*) FILTER (WHERE stability < 0.7::DOUBLE) AS unstable, {rr('avg(stability)')} AS mean_stability FROM d")
def dynamics_summary(spark, sf_dir):
    s = D.summary(history(spark, sf_dir))
    return s.select("samples", "never_correct", "always_correct", "regressed", "unstable", r("mean_stability").alias("mean_stability"))


@query("class_weights_inverse", f"WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, {rr('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)')} AS weight FROM c")
def class_weights_inverse(spark, sf_dir):
    return D.class_weights(vectors(spark, sf_dir)).select("label", "n", r("weight").alias("weight"))


@query("class_weights_effective", f"WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), e AS (SELECT *, (1 - power(0.99::DOUBLE, n)) / (1 - 0.99::DOUBLE) AS f FROM c) SELECT label, n, {rr('(SELECT sum(f) FROM e) / ((SELECT count(*) FROM e) * f)')} AS weight FROM e")
def class_weights_effective(spark, sf_dir):
    return D.class_weights(vectors(spark, sf_dir), beta=0.99).select("label", "n", r("weight").alias("weight"))


@query("sample_weights", f"WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT vec_id AS sample_id, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS w FROM embeddings JOIN c USING (label)) SELECT sample_id, {rr('w / (SELECT avg(w) FROM w)')} AS weight FROM w")
def sample_weights(spark, sf_dir):
    return D.sample_weights(vectors(spark, sf_dir)).select("sample_id", r("weight").alias("weight"))


@query("curriculum_weights", _CE + f", k AS (SELECT sample_id, 1 - 0.9::DOUBLE * (row_number() OVER (ORDER BY -ls, sample_id) - 1) / count(*) OVER () AS w FROM y) SELECT sample_id, {rr('w / (SELECT avg(w) FROM k)')} AS weight FROM k")
def curriculum_weights(spark, sf_dir):
    s = logits(spark, sf_dir).select("sample_id", Z.cross_entropy("logits", "label").alias("loss"))
    return D.curriculum_weights(s).select("sample_id", r("weight").alias("weight"))


@query("pseudo_label_threshold", _T + f" SELECT sample_id, pred, {rr('conf')} AS weight FROM k WHERE conf >= 0.14")
def pseudo_label_threshold(spark, sf_dir):
    return D.pseudo_labels(_preds(spark, sf_dir), "threshold", 0.14).select("sample_id", "pred", r("weight").alias("weight"))


@query("pseudo_label_topk", _T + f" SELECT sample_id, pred, {rr('conf')} AS weight FROM (SELECT *, row_number() OVER (ORDER BY conf DESC, sample_id) AS rn, count(*) OVER () AS n FROM k) WHERE rn <= greatest(round(n * 0.1::DOUBLE), 1)")
def pseudo_label_topk(spark, sf_dir):
    return D.pseudo_labels(_preds(spark, sf_dir), "topk", fraction=0.1).select("sample_id", "pred", r("weight").alias("weight"))


@query("pseudo_label_balanced", _T + f" SELECT sample_id, pred, {rr('conf')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY conf DESC, sample_id) AS rn FROM k) WHERE rn <= 10")
def pseudo_label_balanced(spark, sf_dir):
    return D.pseudo_labels(_preds(spark, sf_dir), "balanced", per_class=10).select("sample_id", "pred", r("weight").alias("weight"))


def _schedule(name, sql, f, digits=9):
    """The rate of every step of every run: a user's events, in order of time, are the steps of a run."""

    @query(name, f"WITH {S} SELECT run_id, s AS step, {rr(sql, digits)} AS value FROM (SELECT sample_id AS run_id, t AS s FROM e)")
    def run(spark, sf_dir):
        steps = events_long(spark, sf_dir).select(F.col("sample_id").alias("run_id"), F.col("t").alias("step"))
        return steps.withColumn("value", r(f(F.col("step")), digits))


_schedule("onecycle_schedule", "CASE WHEN s < 300 THEN 1e-3 / 25 + (1e-3 - 1e-3 / 25) * s / 300 ELSE 1e-7 + (1e-3 - 1e-7) * (1 + cos(pi() * (least(s, 999) - 300) / 700)) / 2 END", lambda s: H.one_cycle(s, 1e-3, 1000))
_schedule("cosine_schedule", "1e-5 + (1e-2 - 1e-5) * (1 + cos(pi() * least(s, 99) / 100)) / 2", lambda s: H.cosine(s, 1e-2, 1e-5, 100))
_schedule("step_schedule", "0.1::DOUBLE * power(0.5::DOUBLE, s // 30)", lambda s: H.step_decay(s, 0.1, 30, 0.5))
_schedule("exponential_schedule", "0.1::DOUBLE * power(0.95::DOUBLE, s)", lambda s: H.exponential(s, 0.1, 0.95))
_schedule("polynomial_schedule", "1e-4 + (0.1::DOUBLE - 1e-4) * power(1 - least(s, 100) / 100, 2)", lambda s: H.polynomial(s, 0.1, 1e-4, 100, 2.0))
_schedule("warm_restarts_schedule", "1e-4 + (0.1::DOUBLE - 1e-4) * (1 + cos(pi() * (s - 20 * (power(2, floor(log2(1 + s / 20) + 1e-12)) - 1)) / (20 * power(2, floor(log2(1 + s / 20) + 1e-12))))) / 2", lambda s: H.warm_restarts(s, 0.1, 1e-4, 20, 2))
_schedule("transform_schedule", "CASE WHEN s >= 10 THEN 0.8::DOUBLE ELSE 0.8::DOUBLE * s / 10 END + CASE WHEN s < 15 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * (1 - (s - 15) / 5) END + 0.1::DOUBLE + 0.4::DOUBLE * (1 + cos(pi() * s / 19)) / 2 + CASE WHEN s >= 12 THEN 0.3::DOUBLE WHEN s >= 6 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN s >= 7 THEN 0.7::DOUBLE ELSE 0 END", lambda s: H.probability(s, "warmup", 20, max_p=0.8, epochs=10) + H.probability(s, "cooldown", 20, max_p=0.5, epochs=5) + H.probability(s, "cosine", 20, min_p=0.1, max_p=0.5) + H.probability(s, "steps", 20, table=[(0, 0.1), (6, 0.2), (12, 0.3)]) + H.probability(s, "delayed", 20, p=0.7, start=7))
