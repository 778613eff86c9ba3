"""URL filtering by rules and, where none fits, by two character language models, in DataFrame operations only.

A rule fits its host and all subdomains when the path begins with the rule's; the longest wins. URLs that a
rule decides are the examples: one variable-order Markov model is counted from the accepted, one from the
rejected. A character is scored under the longest context that either model has seen it in (up to ``ORDER``
characters), with additive smoothing; a URL's score is the difference of its log-likelihoods divided by its
length. A fifth of the examples stays out of the counts and calibrates the threshold: the point between
the means of both classes where two normal curves of their variances are equally likely.

Counts cover all distinct example URLs. URLs go by a number, the windows of a URL are counted before they meet
their scores, and a window is scored once however many URLs share it. Windows with more than one in
``HOT_SHARE`` of all rows (so fewer than ``HOT_SHARE`` of them) are broadcast, the others are joined on the window, so no
task gets more than a small share of the rows for one key.

Edge cases: a null URL or one without ``://`` has empty host and path; only rules with empty host would fit
it; the models judge the empty text by their threshold alone (score 0). Without examples of both classes the
verdict is allow. Repeated rows are judged each; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.storage import stored

ORDER = 4
ALPHA = 0.5
ALPHABET = 96
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL column."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _by_rules(rules: list[tuple[str, str, str]], value) -> Column:
    """``value`` of the longest rule that fits columns host and path; null if none does."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(host, path, verdict))).otherwise(out)
    return out


def _windows(urls: DataFrame, *keep: str) -> DataFrame:
    """A row a character: ``w`` is the character with the ``ORDER`` before it."""
    padded = urls.select(*keep, F.concat(F.lit("\u0002" * ORDER), "chars", F.lit("\u0003")).alias("p"))
    return padded.select(*keep, "p", F.explode(F.expr(f"sequence(1, length(p) - {ORDER})")).alias("i")).select(*keep, F.expr(f"substring(p, i, {ORDER + 1})").alias("w"))


def _suffixes(windows: DataFrame) -> DataFrame:
    """Each window with its last one to ``ORDER`` + 1 characters as ``g``."""
    return windows.select("*", F.explode(F.expr(f"transform(sequence(1, {ORDER + 1}), k -> right(w, k))")).alias("g"))


def model(examples: DataFrame) -> DataFrame:
    """(g, gain): log-probability of the last character of g after the others when accepted, less when rejected. ``examples``: (chars, accepted)."""
    yes, no = (F.count(F.when(F.col("accepted") == a, 1)) for a in (True, False))
    counts = _suffixes(_windows(examples, "accepted").groupBy("w").agg(yes.alias("yes"), no.alias("no"))).groupBy("g").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counts = counts.withColumn("context", F.expr("left(g, length(g) - 1)"))
    totals = counts.groupBy("context").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    chance = lambda n, total: F.log((F.col(n) + ALPHA / ALPHABET) / (F.col(total) + ALPHA))
    return counts.join(totals, "context").select("g", (chance("yes", "all_yes") - chance("no", "all_no")).alias("gain"))


def _resolved(windows: DataFrame, fitted: DataFrame) -> DataFrame:
    """(w, gain) for distinct windows ``w``: the gain of their longest suffix in ``fitted``, or 0.

    Suffixes are looked up once each, and take over from the suffix a character shorter, which has at most as many
    takers as the alphabet has characters.
    """
    own = _suffixes(windows.select("w")).select("g").distinct().join(fitted, "g", "left")
    own = stored(own.select("g", "gain", F.length("g").alias("n")), "suffixes")
    best = own.where("n = 1").select("g", F.coalesce("gain", F.lit(0.0)).alias("gain"))
    for n in range(2, ORDER + 2):
        shorter = best.select(F.col("g").alias("parent"), F.col("gain").alias("before"))
        level = own.where(F.col("n") == n).withColumn("parent", F.expr(f"right(g, {n - 1})"))
        best = level.join(shorter, "parent").select("g", F.coalesce("gain", "before").alias("gain"))
    return best.withColumnRenamed("g", "w")


def scores(urls: DataFrame, fitted: DataFrame) -> DataFrame:
    """(id, score) for distinct rows (id, chars): the mean gain of the characters."""
    each = stored(_windows(urls, "id").groupBy("id", "w").agg(F.count(F.lit(1)).alias("n")), "url-windows")
    rows = each.groupBy("w").agg(F.count(F.lit(1)).alias("urls"))
    best = stored(rows.join(_resolved(rows, fitted), "w"), "window-gains")
    limit = each.count() / HOT_SHARE
    hot, cold = F.broadcast(best.where(F.col("urls") > limit)), best.where(F.col("urls") <= limit)
    near = each.join(hot, "w").union(each.join(hot, "w", "left_anti").join(cold, "w").select("w", "id", "n", "urls", "gain"))
    return near.groupBy("id").agg(F.round(F.sum(F.col("gain") * F.col("n")) / F.sum("n"), 9).alias("score"))


def threshold(calibration: DataFrame) -> float | None:
    """From rows (accepted, score), of which two rows of statistics reach the driver; None without both classes."""
    found = {a: (m, v or 0.0) for a, m, v in calibration.groupBy("accepted").agg(F.avg("score"), F.var_pop("score")).collect()}
    if len(found) < 2:
        return None
    (m1, v1), (m0, v0) = found[True], found[False]
    v1, v0 = max(v1, 1e-6), max(v0, 1e-6)
    if m1 <= m0:
        return (m1 + m0) / 2
    lo, hi = m0, m1
    density = lambda x, m, v: -((x - m) ** 2) / (2 * v) - math.log(v) / 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if density(mid, m1, v1) < density(mid, m0, v0) else (lo, mid)
    return (lo + hi) / 2


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict. ``rules`` become one expression; keep them to some hundreds."""
    rules = RULES if rules is None else rules
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    host, path = parts()
    split = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    split = split.select("*", _by_rules(rules, lambda h, p, v: h + p).alias("rule"), _by_rules(rules, lambda h, p, v: v).alias("ruled"))
    urls = split.select("url", F.concat("host", "path").alias("chars"), "ruled").where("url IS NOT NULL").distinct()
    urls = stored(urls.select("*", (F.pmod(F.crc32("url"), F.lit(5)) == 0).alias("aside"), F.monotonically_increasing_id().alias("id")), "urls")
    fitted = stored(model(urls.where("ruled IS NOT NULL AND NOT aside").select("chars", (F.col("ruled") == "allow").alias("accepted"))), "url-model")
    need = stored(scores(urls.where("ruled IS NULL OR aside").select("id", "chars"), fitted), "url-scores")
    limit = threshold(need.join(urls.where("ruled IS NOT NULL AND aside"), "id").select((F.col("ruled") == "allow").alias("accepted"), "score"))
    open_urls = need.join(urls.where("ruled IS NULL").select("id", "url"), "id").select(F.col("url").alias("of"), "score")
    told = F.lit("allow") if limit is None else F.when(F.coalesce("score", F.lit(0.0)) >= limit, "allow").otherwise("block")
    return split.join(open_urls, split.url == F.col("of"), "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", told).alias("verdict"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
