"""Every query with SQL against DuckDB on the smallest tables, when they are there."""

import os

import duckdb
import pytest

from panelwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["features_all", "features_all_ragged", "sliding_windows_keep_tail", "random_split3", "walk_forward_sliding", "classification_report", "auc_ovr", "ece_mce", "curriculum_weights", "time_warp", "cutmix", "gadf", "grad_cam", "event_windows"]


def canon(rows):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert canon(map(tuple, df.select(*names).collect())) == canon(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())


def test_padding_of_series_that_hold_zeros(spark, tmp_path):
    """Zeros of a series are not padding."""
    rows = [(i, f"2024-01-01 00:00:0{i}", i % 2 if i < 4 else 0, v) for i, v in enumerate([0.0, 1.5, 2.0, 0.0, 0.0, -1.0])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "ts::timestamp_ntz AS ts", "user_id", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, registry.queries()["pad_post"](spark, str(tmp_path)).select("sample_id", "length", "total", "added").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["pad_post"]).select("sample_id", "length", "total", "added").fetchall())
    assert got == want and [r[3] for r in got] == [0, 2]
