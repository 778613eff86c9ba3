"""The shapes that operators share, and the ways between them.

panel   sample_id BIGINT, var_id INT, x ARRAY<DOUBLE>    one row a sample and variable
long    sample_id BIGINT, var_id INT, t INT, value DOUBLE
targets sample_id BIGINT, y ARRAY<DOUBLE>, label INT, weight DOUBLE, split STRING
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["sample_id", "var_id"]


def to_long(panel: DataFrame) -> DataFrame:
    return panel.select(*KEY, F.posexplode("x").alias("t", "value"))


def to_panel(long: DataFrame) -> DataFrame:
    """Series in order of ``t``; the order of the rows doesn't matter."""
    cells = F.array_sort(F.collect_list(F.struct("t", "value")))
    return long.groupBy(*KEY).agg(F.transform(cells, lambda c: c["value"]).alias("x"))


def wide_to_panel(df: DataFrame, sample_id: str, columns: list[str], n_vars: int, keep: list[str] | None = None) -> DataFrame:
    """Columns in order (var 0 step 0, var 0 step 1, ...) of each row, with the columns of ``keep``; missing and unreadable cells become 0."""
    if n_vars < 1 or len(columns) % n_vars:
        raise ValueError(f"{len(columns)} columns don't make {n_vars} variables")
    length = len(columns) // n_vars
    cell = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0))
    series = [F.struct(F.lit(v).alias("var_id"), F.array(*[cell(c) for c in columns[v * length : (v + 1) * length]]).alias("x")) for v in range(n_vars)]
    keep = keep or []
    return df.select(F.col(sample_id).cast("long").alias("sample_id"), *keep, F.explode(F.array(*series)).alias("s")).select("sample_id", "s.var_id", "s.x", *keep)


def transpose(panel: DataFrame) -> DataFrame:
    """Steps become variables: (sample_id, t, x over var_id)."""
    cells = F.array_sort(F.collect_list(F.struct("var_id", "value")))
    return to_long(panel).groupBy("sample_id", "t").agg(F.transform(cells, lambda c: c["value"]).alias("x"))


def shape(panel: DataFrame) -> DataFrame:
    """One row: n_samples, n_vars, seq_len."""
    return panel.agg(F.countDistinct("sample_id").alias("n_samples"), (F.coalesce(F.max("var_id"), F.lit(-1)) + 1).alias("n_vars"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("seq_len"))


def data_quality(panel: DataFrame) -> DataFrame:
    """One row: cells, NaN or null cells, infinite cells, and min, max, mean and population deviation of the others."""
    v = F.explode("x").alias("v")
    bad = F.col("v").isNull() | F.isnan("v")
    fine = F.when(~bad & (F.abs("v") != float("inf")), F.col("v"))
    return panel.select(v).agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_missing"), F.coalesce(F.sum((~bad & (F.abs("v") == float("inf"))).cast("long")), F.lit(0)).alias("n_infinite"),
        F.min(fine).alias("min"), F.max(fine).alias("max"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"),
    )


def select_rows(panel: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``index`` (pos, sample_id) in its order, repeated as often as it names them."""
    return index.select("pos", "sample_id").join(panel, "sample_id").select("pos", *panel.columns)


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; the columns must agree."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b)


def label_codes(df: DataFrame, label: str = "label", out: str = "code") -> DataFrame:
    """Codes 0, 1, ... of the sorted distinct labels, for train and test together; the labels are few and joined back by value."""
    from pyspark.sql import Window

    codes = df.select(label).where(F.col(label).isNotNull()).distinct().select(F.col(label).alias("_l"), (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias(out))
    return df.join(codes, df[label] == codes["_l"], "left").drop("_l")


def one_hot(code: Column | str, n: int) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.array(*[(c == i).cast("double") for i in range(n)])


def stack_variables(frames: list[DataFrame]) -> DataFrame:
    """One panel of several univariate frames (sample_id, x): frame i becomes variable i."""
    out = None
    for i, f in enumerate(frames):
        part = f.select("sample_id", F.lit(i).alias("var_id"), "x")
        out = part if out is None else out.unionByName(part)
    return out


def mixed_input(panel: DataFrame, tabular: DataFrame) -> DataFrame:
    """Series and tabular columns of the same samples, side by side; samples that only one of them has are an error."""
    series = panel.select("sample_id").distinct()
    rows = tabular.select("sample_id").distinct()
    odd = series.join(rows, "sample_id", "left_anti").union(rows.join(series, "sample_id", "left_anti"))
    if not odd.isEmpty():
        raise ValueError("series and table name different samples")
    return panel.join(tabular, "sample_id")


def labelled_union(labelled: DataFrame, pseudo: DataFrame) -> DataFrame:
    """(sample_id, label, weight): true labels with weight 1 and pseudo-labels (sample_id, pred, weight) of samples without one."""
    extra = pseudo.join(labelled.select("sample_id"), "sample_id", "left_anti").select("sample_id", F.col("pred").alias("label"), "weight")
    return labelled.select("sample_id", "label", F.lit(1.0).alias("weight")).unionByName(extra)


def class_count(*frames: DataFrame, label: str = "label") -> int:
    """Different labels over all frames, as in train and test together."""
    both = frames[0].select(label)
    for f in frames[1:]:
        both = both.union(f.select(label))
    return both.agg(F.countDistinct(label)).first()[0]


def filled(samples: DataFrame, n_vars: int, length: int, value: float = 0.0) -> DataFrame:
    """A panel of one value for the ids of ``samples``: zeros, ones, or with ``value`` 1 a mask of valid steps."""
    cells = F.array_repeat(F.lit(float(value)), length)
    return samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_vars - 1))).alias("var_id")).withColumn("x", cells)


def channels(images: dict[str, Column], order: list[str] | None = None) -> Column:
    """Images of one series as an array (channel, row, column), in the given order."""
    return F.array(*[images[k] for k in order or list(images)])


def numel(panel: DataFrame) -> DataFrame:
    """One row: the number of cells."""
    return panel.agg(F.coalesce(F.sum(F.size("x")), F.lit(0)).cast("long").alias("cells"))


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two panels agree in variables and length, so that they may be joined end to end."""
    one, two = (shape(p).select("n_vars", "seq_len") for p in (a, b))
    left, right = one.toDF("v", "n"), two.toDF("w", "m")
    return left.crossJoin(right).select(((F.col("v") == F.col("w")) & (F.col("n") == F.col("m"))).alias("compatible"))  # two single rows
