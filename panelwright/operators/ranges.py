"""Global orders without a task that sees all rows.

Up to ``ROWS_A_RANGE`` rows are ranked by one window. More are dealt into ranges of a value, cut at approximate
quantiles of it, so each range holds about ``ROWS_A_RANGE`` rows whatever the distribution; only counts by range are
gathered, and ranks are made inside a range. There are ``MOST_RANGES`` at most: beyond 8 billion rows the ranges
grow, and a task sorts its own on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_RANGE = 1_000_000
MOST_RANGES = 8192


def cuts(df: DataFrame, value: str, n: int | None = None) -> list[float]:
    """Where the numeric column ``value`` is cut into ranges of about ``ROWS_A_RANGE`` rows: nowhere if ``n`` rows (counted if not given) make one range."""
    n = df.count() if n is None else n
    k = min(-(-n // ROWS_A_RANGE), MOST_RANGES)
    if k <= 1:
        return []
    v = F.col(value).cast("double")
    found = df.agg(F.percentile_approx(F.when(~F.isnan(v), v), [i / k for i in range(1, k)], max(10_000, 10 * k))).first()[0]
    return sorted(found or [])


def _passed(at: list[float], v: Column, equal: bool) -> Column:
    """How many of the sorted values ``at`` lie below ``v`` (or equal it), by bisection."""
    cut = F.array(*[F.lit(x) for x in at])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(at).bit_length()))])

    def further(found: Column, step: Column) -> Column:
        here = F.get(cut, found + step - 1)
        return F.when((found + step <= len(at)) & (here <= v if equal else here < v), found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), further)


def in_ranges(df: DataFrame, value: str, at: list[float], out: str = "_r", spread: Column | None = None) -> DataFrame:
    """Adds ``out``, a number that grows with the numeric column ``value``, by the ``cuts`` ``at``.

    Equal values share it, but with ``spread``, a column of whole numbers, those of a value that fills several ranges
    are dealt over these by it. Nulls come first and NaN last, as in Spark's order.
    """
    v = F.col(value).cast("double")
    place = _passed(at, v, True) if at else F.lit(0)
    if spread is not None and len(set(at)) < len(at):
        below = _passed(at, v, False)
        place = F.when(place - below > 1, below + 1 + F.pmod(spread, place - below)).otherwise(place)
    return df.withColumn(out, F.when(v.isNull(), -1).when(F.isnan(v), len(at) + 1).otherwise(place).cast("long"))


def before(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, _r, _before): what ``weight`` (1 a row) adds up to in all earlier ranges."""
    counts = df.groupBy(*by, "_r").agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "_r", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def ranked(df: DataFrame, order: list, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rank 0, 1, ... (in each group of ``by``) of rows that have their range in ``_r``; without that column, of so few rows that one window ranks them."""
    by = by or []
    if "_r" not in df.columns:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    inside = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_r").orderBy(*order)))
    names = {b: f"_by{i}" for i, b in enumerate(by)}
    first = before(df, by).withColumnsRenamed({**names, "_r": "_q"})
    same = F.col("_r") == F.col("_q")
    for b, name in names.items():
        same = same & F.col(b).eqNullSafe(F.col(name))
    joined = inside.join(first if by else F.broadcast(first), same)  # without groups a row a range
    return joined.withColumn(out, (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_r", "_q", "_k", "_before", *names.values())
