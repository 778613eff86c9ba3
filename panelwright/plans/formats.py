"""File formats: a table is written in a format and read again by its reader, and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import schema
from panelwright.plans.registry import query
from panelwright.plans.tables import E, events_panel, r, rr, table, vectors
from panelwright.session import scratch
from panelwright.sources import readers, writers
from panelwright.sources.catalog import catalog as catalog_of


def _text(x, between: str = ","):
    return F.array_join(F.transform(x, lambda v: v.cast("string")), between)


def _written(df, name: str, kind: str = "text") -> str:
    path = scratch(df.sparkSession, name)
    {"text": df.write.text, "csv": lambda p: df.write.csv(p, header=True), "parquet": df.write.parquet}[kind](path)
    return path


def _cells(panel, *keys):
    return panel.select(*keys, F.posexplode("x").alias("t", "v")).select(*keys, "t", r("v").alias("value"))


def _wide(spark, sf_dir):
    """(sample_id, var 0 step 0 ... var 3 step 15, label)."""
    v = vectors(spark, sf_dir)
    return v.select("sample_id", *[F.get("x", F.lit(16 * i + t)).alias(f"v{i}_t{t}") for i in range(4) for t in range(16)], F.col("label").cast("double").alias("label"))


_QUARTERS = f"WITH {E} SELECT sample_id, (t // 16)::INT AS var_id, label::DOUBLE AS label, (t % 16)::INT AS t, {rr('v')} AS value FROM e"


@query("read_csv", _QUARTERS)
def read_csv(spark, sf_dir):
    got = readers.read_csv(spark, _written(_wide(spark, sf_dir), "wide", "csv"), 4, 16, has_labels=True, id_col="sample_id")
    return _cells(got, "sample_id", "var_id", "label")


@query("read_parquet", _QUARTERS)
def read_parquet(spark, sf_dir):
    columns = [f"v{i}_t{t}" for i in range(4) for t in range(16)]
    got = readers.read_parquet(spark, _written(_wide(spark, sf_dir), "wide", "parquet"), columns, 4, label="label", sample_id="sample_id")
    return _cells(got, "sample_id", "var_id", "label")


def _tsv(rows, name: str) -> str:
    """Lines ``label id v0 ... v63``: the first value is the sample's id, since readers number the lines themselves."""
    return _written(rows.select(F.concat_ws("\t", F.col("label").cast("string"), F.col("sample_id").cast("string"), _text(F.col("x"), "\t")).alias("value")), name)


def _by_id(panel, *keys):
    """Cells by the id that stands in the first value."""
    named = panel.select(F.get("x", F.lit(0)).cast("long").alias("sample_id"), *keys, F.slice("x", F.lit(2), F.size("x") - 1).alias("x"))
    return _cells(named, "sample_id", *keys)


_CELLS = f"sample_id, label::DOUBLE AS label, t::INT AS t, {rr('v')} AS value FROM e"


@query("read_tsv", f"WITH {E} SELECT {_CELLS}")
def read_tsv(spark, sf_dir):
    return _by_id(readers.read_tsv(spark, _tsv(vectors(spark, sf_dir), "tsv")), "label")


@query("read_archive", f"WITH {E} SELECT CASE WHEN sample_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, 1::BIGINT AS rows_of_id, {_CELLS}")
def read_archive(spark, sf_dir):
    from pyspark.sql import Window

    v = vectors(spark, sf_dir)
    both = readers.read_archive(spark, _tsv(v.where("sample_id % 3 <> 0"), "train"), _tsv(v.where("sample_id % 3 = 0"), "test"))
    counted = both.withColumn("rows_of_id", F.count(F.lit(1)).over(Window.partitionBy("sample_id")))
    return _by_id(counted, "label", "split", "rows_of_id")


@query("remap_labels", "SELECT vec_id AS sample_id, label::DOUBLE AS label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM embeddings")
def remap_labels(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("sample_id", F.col("label").cast("double").alias("label"))
    train, test = readers.remap_labels(rows.where("sample_id % 3 <> 0"), rows.where("sample_id % 3 = 0"))
    return train.unionByName(test)


def _ts(rows, last: str, name: str) -> str:
    """Two dimensions, ``id,x0 ... x39`` and ``x40 ... x63`` (shorter, so the reader fills it up)."""
    v = rows.select(F.concat(F.concat_ws(",", F.col("sample_id").cast("string"), _text(F.slice("x", 1, 40))), F.lit(":"), _text(F.slice("x", 41, 24)), F.lit(":"), F.expr(last)).alias("value"))
    return _written(v, name)


_TS = f"SELECT x.sample_id, {{label}}, list_transform(x[1:40], lambda v: {rr('v')}) AS first, list_transform(x[41:64] || list_transform(range(17), lambda i: {{fill}}::DOUBLE), lambda v: {{out}}) AS second FROM x"


def _two(panel, label: str):
    """(sample_id, label, both dimensions), joined by the reader's own id."""
    a = panel.where("var_id = 0").select("sample_id", label, F.get("x", F.lit(0)).cast("long").alias("id"), F.slice("x", 2, 40).alias("first"))
    b = panel.where("var_id = 1").select("sample_id", F.col("x").alias("second"))
    fine = lambda c: F.transform(c, lambda v: F.when(F.isnan(v), F.lit(-9.0)).otherwise(r(v)))
    return a.join(b, "sample_id").select(F.col("id").alias("sample_id"), label, fine("first").alias("first"), fine("second").alias("second"))


_X = "x AS (SELECT vec_id AS sample_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings)"


@query("read_ts", f"WITH {_X} " + _TS.format(label="'class' || label AS label", fill="x[64]", out=rr("v")))
def read_ts(spark, sf_dir):
    return _two(readers.read_ts(spark, _ts(vectors(spark, sf_dir), "concat('class', label)", "ts")), "label")


@query("read_ts_regression", f"WITH {_X} " + _TS.format(label="label / 4 AS target", fill="-9", out=f"CASE WHEN v = -9 THEN -9 ELSE {rr('v')} END"))
def read_ts_regression(spark, sf_dir):
    return _two(readers.read_ts(spark, _ts(vectors(spark, sf_dir), "string(label / 4)", "ts"), target="value"), "target")


@query("read_tsf", f"SELECT 'T' || user_id AS series_id, '2020-01-01 00-00-00' AS start, count(*)::INT AS n, {rr('sum(value)', 4)} AS total FROM events GROUP BY 1")
def read_tsf(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    line = F.concat(F.lit("T"), F.col("sample_id").cast("string"), F.lit("|2020-01-01 00-00-00:"), _text(F.col("x")), F.lit(",?"))
    head = spark.createDataFrame([("@frequency daily",), ("@horizon 7",), ("@data",)], "value string")
    got = readers.read_tsf(spark, _written(head.union(p.select(line.alias("value"))), "tsf"))
    known = F.filter("x", lambda v: ~F.isnan(v))
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return got.select("series_id", "start", F.size(known).alias("n"), r(total, 4).alias("total"))


_TSF_ATTRIBUTES = """
SELECT name, value, CASE (SELECT max(value) FROM events) > 100 WHEN true THEN 30 ELSE 48 END AS default_horizon
FROM (SELECT 'frequency' AS name, CASE (SELECT max(value) FROM events) > 100 WHEN true THEN 'daily' ELSE 'hourly' END AS value
  UNION ALL SELECT 'horizon', (SELECT count(DISTINCT user_id)::VARCHAR FROM events) UNION ALL SELECT 'data', '')
"""


@query("tsf_attributes", _TSF_ATTRIBUTES)
def tsf_attributes(spark, sf_dir):
    """The header of a file whose horizon and frequency follow the table."""
    e = table(spark, sf_dir, "events")
    facts = e.agg(F.concat(F.lit("@horizon "), F.count_distinct("user_id").cast("string")).alias("h"), F.when(F.max("value") > 100, "@frequency daily").otherwise("@frequency hourly").alias("f"))
    lines = facts.select(F.explode(F.array("f", "h", F.lit("@data"))).alias("value"))
    series = e.groupBy("user_id").agg(F.sum("value").alias("v")).select(F.concat(F.lit("T"), F.col("user_id").cast("string"), F.lit("|2020-01-01 00-00-00:"), F.col("v").cast("string")).alias("value"))
    found = readers.tsf_attributes(spark, _written(lines.union(series), "tsf"))
    rows = spark.createDataFrame([(k, v, found["frequency"]) for k, v in found.items()], "name string, value string, frequency string")
    return rows.select("name", "value", readers.default_horizon(F.col("frequency")).alias("default_horizon"))


_NAMES = ["daily", "Hours", "w", "monthly", "annual", "decade", "minutely", "quarterly"]


@query("default_horizon", f"SELECT user_id, ({_NAMES})[user_id % 8 + 1] AS frequency, [30, 48, 8, 12, 4, 10, 60, 4][user_id % 8 + 1] AS horizon FROM events GROUP BY user_id")
def default_horizon(spark, sf_dir):
    """A name of a frequency for each series, and the horizon that goes with it."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    named = users.withColumn("frequency", F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("user_id") % 8).cast("int")))
    return named.withColumn("horizon", readers.default_horizon(F.col("frequency")))


_NPY = f"WITH {E} SELECT sample_id, t::INT AS t, {rr('v')} AS value FROM e"


@query("read_npy", _NPY)
def read_npy(spark, sf_dir):
    v = vectors(spark, sf_dir).select("sample_id", "var_id", F.concat(F.array(F.col("sample_id").cast("double")), F.col("x")).alias("x"))
    return _by_id(readers.read_npy(spark, writers.write_npy(v, scratch(spark, "npy"))))


@query("read_npz", _NPY)
def read_npz(spark, sf_dir):
    v = vectors(spark, sf_dir).select("sample_id", "var_id", F.concat(F.array(F.col("sample_id").cast("double")), F.col("x")).alias("x"))
    return _by_id(readers.read_npy(spark, writers.write_npy(v, scratch(spark, "npz"), key="x"), key="x"))


@query("write_time_csv", f"WITH {E} SELECT sample_id, (t % 32)::INT AS time, {rr('max(v) FILTER (WHERE t < 32)')} AS var0, {rr('max(v) FILTER (WHERE t >= 32)')} AS var1 FROM e GROUP BY 1, 2")
def write_time_csv(spark, sf_dir):
    v = vectors(spark, sf_dir)
    panel = schema.stack_variables([v.select("sample_id", F.slice("x", 1 + 32 * i, 32).alias("x")) for i in range(2)])
    path = scratch(spark, "time-csv")
    writers.write_time_csv(panel, path, 2)
    got = spark.read.schema("sample_id long, time int, var0 double, var1 double").csv(path, header=True)
    return got.select("sample_id", "time", r("var0").alias("var0"), r("var1").alias("var1"))


@query("write_json", "SELECT user_id, count(*) AS n, min(event_type) AS first_type FROM events GROUP BY 1")
def write_json(spark, sf_dir):
    path = scratch(spark, "json")
    writers.write_json(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("first_type")), path)
    return spark.read.schema("user_id long, n long, first_type string").json(path)


@query("write_panel", f"WITH {E} SELECT sample_id, 0 AS var_id, t::INT AS t, {rr('v')} AS value FROM e")
def write_panel(spark, sf_dir):
    path = scratch(spark, "panel")
    writers.write_panel(vectors(spark, sf_dir).select("sample_id", "var_id", "x"), path, 4)
    return _cells(spark.read.parquet(path), "sample_id", "var_id")


@query("catalog", "SELECT 'kind' || label AS name, 'tsv' AS format, 'read_tsv' AS reader, split, (count(*) > 0)::INT AS there FROM embeddings, (SELECT unnest(['train', 'test']) AS split) WHERE (vec_id % 3 = 0) = (split = 'test') GROUP BY label, split")
def catalog(spark, sf_dir):
    """A data set a label, each with its training and test file."""
    v, folder = vectors(spark, sf_dir), scratch(spark, "catalog")
    split = F.when(F.col("sample_id") % 3 == 0, "TEST").otherwise("TRAIN")
    lines = v.select(F.concat(F.lit("kind"), F.col("label").cast("string"), F.lit("_"), split, F.lit(".tsv")).alias("file"), F.concat_ws("\t", F.col("label").cast("string"), _text(F.col("x"), "\t")).alias("value"))
    lines.repartition(F.col("file")).write.partitionBy("file").text(folder)
    found = catalog_of(spark, folder)
    return found.groupBy(F.regexp_replace("name", "^file=", "").alias("name"), F.lit("tsv").alias("format"), F.lit("read_tsv").alias("reader"), "split").agg((F.sum("files") > 0).cast("int").alias("there"))
