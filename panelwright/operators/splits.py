"""Train, validation and test splits, cross-validation folds, samplers and batches over rows with an id.

Orders are global where the semantics are (a shuffle cut at a count, consecutive batches). Such a rank is
made by ranges (see operators.ranges), so no task holds all rows and the number of ranges follows their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.rand import bits
from panelwright.operators.ranges import ROWS_A_RANGE, cuts, in_ranges, ranked



def _hashed(df: DataFrame, order: Column, n: int | None) -> DataFrame:
    """Adds ``_o``, a hash of 32 bits as ``bits`` gives, and its range if one isn't enough; hashes are even, so equal widths do."""
    ranges = -(-(df.count() if n is None else n) // ROWS_A_RANGE)
    out = df.withColumn("_o", order)
    return out.withColumn("_r", F.floor(F.col("_o") / (2**32 / ranges)).cast("long")) if ranges > 1 else out


def global_rank(df: DataFrame, order: Column, id_col: str, out: str = "rank", n: int | None = None) -> DataFrame:
    """Rank 0, 1, ... of all ``n`` rows by (``order``, ``id_col``). ``order`` is a 32-bit integer, as ``bits`` gives."""
    return ranked(_hashed(df, order, n), ["_o", id_col], out).drop("_o")


def rank_by_id(df: DataFrame, id_col: str, out: str = "rank", n: int | None = None) -> DataFrame:
    """Rank of all ``n`` rows by their numeric id; any distribution of ids will do, rows of one id in an order of their own."""
    at = cuts(df, id_col, n)
    return ranked(in_ranges(df, id_col, at, spread=F.xxhash64(*df.columns)) if at else df, [id_col], out)


def _count(n: int, ratio: float) -> int:
    """Half away from zero."""
    return int(n * ratio + 0.5)


def random_split(df: DataFrame, ratio: float = 0.2, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Adds ``split``: the first round(n ratio) rows of a shuffle are test, one at least and not all."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    n = df.count()
    k = min(max(_count(n, ratio), 1), n - 1)
    return global_rank(df, bits(seed, "split", id_col), id_col, n=n).withColumn("split", F.when(F.col("rank") < k, "test").otherwise("train")).drop("rank")


def random_split3(df: DataFrame, valid: float, test: float, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Test rows first in the shuffle, then validation, then training."""
    if not 0 < valid + test < 1 or min(valid, test) <= 0:
        raise ValueError("ratios must be positive and sum to less than 1")
    n = df.count()
    t, v = max(_count(n, test), 1), max(_count(n, valid), 1)
    if t + v >= n:
        raise ValueError("nothing left to train on")
    return global_rank(df, bits(seed, "split", id_col), id_col, n=n).withColumn("split", F.when(F.col("rank") < t, "test").when(F.col("rank") < t + v, "valid").otherwise("train")).drop("rank")


def time_split(df: DataFrame, train: float, valid: float, gap: int = 0, order_by: str = "sample_id") -> DataFrame:
    """Consecutive parts in order of an integer column, ``gap`` rows left out before validation and before test."""
    n = df.count()
    nt, nv = _count(n, train), _count(n, valid)
    v0, v1 = nt + gap, min(nt + gap + nv, n)
    t0 = v1 + gap
    k = F.col("rank")
    part = F.when(k < nt, "train").when((k >= v0) & (k < v1), "valid").when(k >= t0, "test")
    return rank_by_id(df, order_by, n=n).withColumn("split", part).where("split IS NOT NULL").drop("rank")


def walk_forward(n: int, folds: int, min_train: int | float, test: int | float, gap: int = 0, expanding: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_start, train_end, test_start, test_end) with exclusive ends; sizes below 1 are fractions of ``n``."""
    size = lambda s: _count(n, s) if isinstance(s, float) else s
    m, k = size(min_train), size(test)
    if folds < 2 or m + gap + k > n:
        raise ValueError("at least two folds, and rows for one training and test part, are needed")
    step = (n - m - gap) // folds
    if step < k:
        raise ValueError("test parts would overlap")
    out = []
    for f in range(folds):
        ts = m + gap + f * step
        out.append((f, 0 if expanding else max(ts - gap - m, 0), ts - gap, ts, min(ts + k, n)))
    return out


def walk_forward_folds(df: DataFrame, folds: list[tuple[int, int, int, int, int]], order_by: str = "sample_id") -> DataFrame:
    """A row for each (row, fold) with ``part`` train or test: each row names its folds by itself, without a join."""
    k = F.col("rank")
    parts = [F.struct(F.lit(f).alias("fold"), F.when((k >= a) & (k < b), "train").when((k >= c) & (k < d), "test").alias("part")) for f, a, b, c, d in folds]
    ranked = rank_by_id(df, order_by)
    return ranked.select(*df.columns, F.explode(F.filter(F.array(*parts), lambda p: p["part"].isNotNull())).alias("_p")).select(*df.columns, "_p.fold", "_p.part")


def stratified_split(df: DataFrame, valid: float = 0.2, seed: int = 42, id_col: str = "sample_id", label: str = "label") -> DataFrame:
    """int(n_c valid) rows of each class are valid. Large classes are ranked in ranges of the shuffle."""
    return _by_class(df, F.floor(F.col("_n") * valid), "valid", "train", seed, id_col, label)


def limited_labels(df: DataFrame, fraction: float, seed: int = 42, id_col: str = "sample_id", label: str = "label") -> DataFrame:
    """Labels of max(1, int(n_c fraction)) rows a class stay (``split`` labelled), the others' go."""
    return _by_class(df, F.greatest(F.floor(F.col("_n") * fraction), F.lit(1)), "labelled", "unlabelled", seed, id_col, label)


def _by_class(df: DataFrame, take: Column, yes: str, no: str, seed: int, id_col: str, label: str) -> DataFrame:
    rows = class_rank(df, seed, id_col, label)
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    return joined.withColumn("split", F.when(F.col("class_rank") < take, yes).otherwise(no)).drop("class_rank", "_l", "_n")


def class_rank(df: DataFrame, seed: int, id_col: str = "sample_id", label: str = "label", op: str = "class") -> DataFrame:
    """Rank 0, 1, ... of each row in a shuffle of its class, made by ranges as global_rank is."""
    return ranked(_hashed(df, bits(seed, op, id_col), None), ["_o", id_col], "class_rank", [label]).drop("_o")


def stratified_order(df: DataFrame, seed: int = 42, id_col: str = "sample_id", label: str = "label") -> DataFrame:
    """Round robin over the sorted classes, shuffled inside each: adds ``class_rank``; order by (class_rank, label)."""
    return class_rank(df, seed, id_col, label, "stratified")


def batches(df: DataFrame, size: int, shuffle: bool = False, drop_last: bool = False, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """Adds ``batch_id``; ``drop_last`` leaves an incomplete last batch out."""
    if size < 1:
        raise ValueError("a batch needs at least one row")
    n = df.count()
    ranked = global_rank(df, bits(seed, "batch", id_col), id_col, n=n) if shuffle else rank_by_id(df, id_col, n=n)
    out = ranked.withColumn("batch_id", F.floor(F.col("rank") / size).cast("long"))
    if drop_last:
        out = out.where(F.col("batch_id") < n // size)
    return out.drop("rank")


def loaders(df: DataFrame, size: int = 32, valid_size: int | None = None, seed: int = 42, id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """The batches of training rows, shuffled, and of the others, in order and by default twice as large, of rows with ``split`` (train or another).

    Both keep the last batch; each has ``batch_id`` of its own.
    """
    train, valid = df.where("split = 'train'"), df.where("split <> 'train'")
    return batches(train, size, shuffle=True, seed=seed, id_col=id_col), batches(valid, valid_size or 2 * size, id_col=id_col)


def batch_subsample(df: DataFrame, fraction: float, how: str = "random", seed: int = 42, id_col: str = "sample_id", loss: str = "loss") -> DataFrame:
    """max(1, round(n fraction)) rows of each ``batch_id``: ``random``, ``hard`` (highest loss) or ``easy``."""
    order = {"random": [bits(seed, "subsample", id_col).asc()], "hard": [F.col(loss).desc()], "easy": [F.col(loss).asc()]}[how]
    w = Window.partitionBy("batch_id")
    k = F.row_number().over(w.orderBy(*order, id_col))
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("_k", k).withColumn("_n", n).where(F.col("_k") <= F.greatest(F.round(F.col("_n") * fraction), F.lit(1))).drop("_k", "_n")
