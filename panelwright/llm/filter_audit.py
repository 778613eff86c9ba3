"""How filters interact: every order of them, counted from sums of signs instead of from runs.

A document fails a set of the filters, a mask of one bit each. For each part and kind of label, one sum a subset
of the filters adds up +1 or -1, by the parity of the failures within the subset: the Walsh-Hadamard transform of
the counts by mask. The sums merge before the shuffle, so what meets in a task is a row a part, label and task.
The transform is its own inverse up to the factor, so the counts by mask come back exactly, and from these every
order is evaluated: a document goes at the first filter of the order that it fails. The share of a filter in all
orders needs no order at all: a document that fails k filters goes at each of them in (number of orders) / k.

Equal texts meet by a digest, of which only the smallest doc_id is kept; a document is a later copy unless it is
found again under (digest, smallest doc_id). No group of copies meets in a task.

Edge cases: a null text counts as empty, a null part as the empty string; a null doc_id is no smaller one, has no
labels and is no later copy; a repeated doc_id is judged a row each; labels that repeat a doc_id count if any of
them does; a null label counts as 0; an empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.storage import stored

WORD_GAP = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, those of the text alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(80),
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100) > F.length(text) * F.lit(10),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: dict[str, Column], copies: str, part: str) -> DataFrame:
    """(doc_id, part, mask) a row: bit i is set if filter i fails; ``copies``, the last filter, fails texts of a smaller doc_id."""
    bit = {f: F.lit(1 << i) for i, f in enumerate([*filters, copies])}
    own = sum((F.when(fails, bit[f]).otherwise(0) for f, fails in filters.items()), F.lit(0))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            own.cast("int").alias("own"),
            F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)).alias("digest"),
        ),
        "filter-masks",
    )
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = named.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(F.col("first"), F.col("own")).otherwise(F.col("own") + bit[copies]).alias("mask"))
    return later.unionByName(rows.where("doc_id IS NULL").select("doc_id", "part", F.col("own").alias("mask")))


def parity(mask: Column, subset: int) -> Column:
    """+1 where ``mask`` has an even number of bits in ``subset``, else -1."""
    return F.lit(1) - F.lit(2) * (F.bit_count(mask.bitwiseAND(F.lit(subset))) % 2)


def spectrum(masked: DataFrame, n: int) -> DataFrame:
    """The 2^n sums of signs of each (part, good, toxic), as array ``sums`` with the subset as place."""
    sums = masked.groupBy("part", "good", "toxic").agg(*[F.sum(parity(F.col("mask"), s)).alias(f"s{s}") for s in range(1 << n)])
    return sums.select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(1 << n)]).alias("sums"))


def cells(sums: DataFrame, n: int) -> DataFrame:
    """The counts by mask, array ``cells``: the transform once more, divided by 2^n, which leaves no remainder."""
    subsets = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def back(m: Column) -> Column:
        signed = F.zip_with("sums", subsets, lambda x, s: x * (F.lit(1) - F.lit(2) * (F.bit_count(s.bitwiseAND(m)) % 2)))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x), n)

    return sums.withColumn("cells", F.transform(subsets, back)).drop("sums")


def evaluate(counts: DataFrame, filters: str) -> DataFrame:
    """Every order and step of each part, from the counts by mask of its kinds of label."""
    n = len(filters)
    by_mask = counts.select("part", "good", "toxic", F.posexplode("cells").alias("mask", "n")).groupBy("part", "mask").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda letter: F.expr(f"shiftleft(1, instr('{filters}', {letter}) - 1)")
    placed = steps.withColumns({
        "own": bit("substring(filter_order, step, 1)"),
        "before": F.expr(f"aggregate(sequence(0, step - 1), 0, (a, i) -> a + IF(i = 0, 0, shiftleft(1, instr('{filters}', substring(filter_order, i, 1)) - 1)))"),
    })

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    turns = F.array(*[F.lit(math.factorial(n) // max(k, 1)).cast("long") for k in range(n + 1)])

    def added(kind: str, where, times=lambda m: F.lit(1)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), c[kind] * times(c["mask"])).otherwise(0))

    return placed.select(
        "part", "filter_order", "step",
        added("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        added("all", lambda m: fails(m) & ~gone(m)).alias("removed"),
        added("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        added("all", lambda m: m == F.col("own")).alias("unique_fails"),
        added("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        added("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        added("all", fails, lambda m: turns[F.bit_count(m)]).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str = "E", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step; columns as ``op12``. ``filters``: up to six, conditions of a row of ``docs``."""
    masked = masks(docs, filters, copies, part)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    named = masked.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    others = masked.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    n = len(filters) + 1
    return evaluate(cells(spectrum(named.unionByName(others), n), n), "".join([*filters, copies]))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), text_filters(docs["text"]))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT t, min(doc_id) AS lo FROM d GROUP BY t
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lo, false)::INT AS mask
  FROM d JOIN s USING (t) LEFT JOIN l USING (doc_id)
), f AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask
), e(a) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
  SELECT p.a || q.a || r.a || u.a || v.a AS filter_order FROM e p, e q, e r, e u, e v
  WHERE len(list_distinct([p.a, q.a, r.a, u.a, v.a])) = 5
), k AS (
  SELECT filter_order, step::INT AS step, (1 << (instr('ABCDE', filter_order[step]) - 1))::INT AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1)))::INT AS earlier
  FROM o, unnest(range(1, 6)) AS r(step)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (own | coalesce(earlier, 0)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(x) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0) = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM f, k GROUP BY part, filter_order, step
"""
