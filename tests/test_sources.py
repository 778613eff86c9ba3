import math

import numpy as np
import pytest

from panelwright.sources import readers, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", "v0_t0,v0_t1,v1_t0,v1_t1,label\n1,2,x,4,7\n")
    got = {r.var_id: r.x for r in readers.read_csv(spark, p, 2, 2, has_labels=True).collect()}
    assert got == {0: [1, 2], 1: [0, 4]}


def test_tsv_and_labels(spark, tmp_path):
    a = readers.read_tsv(spark, write(tmp_path / "a.tsv", "3\t1\t2\n\n5 x 4\n"))
    rows = sorted(a.collect(), key=lambda r: r.label)
    assert rows[0].x == [1, 2] and math.isnan(rows[1].x[0])
    b = readers.read_tsv(spark, write(tmp_path / "b.tsv", "5\t1\n"))
    _, test = readers.remap_labels(a, b)
    assert test.first().code == 1


def test_ts(spark, tmp_path):
    p = write(tmp_path / "a.ts", "@problemName x\n@data\n1,2,3:4,?:class1\n")
    got = {r.var_id: r for r in readers.read_ts(spark, p).collect()}
    assert got[0].label == "class1" and got[0].x == [1, 2, 3] and math.isnan(got[1].x[1]) and len(got[1].x) == 3
    r = readers.read_ts(spark, write(tmp_path / "b.ts", "@data\n1,2:3,4:1.5\n"), target="value").collect()
    assert [x.target for x in r] == [1.5, 1.5]


def test_tsf(spark, tmp_path):
    p = write(tmp_path / "a.tsf", "@frequency daily\n@horizon 7\n@data\nT1|2020-01-01 00-00-00:1,2,?\nT2:3\n")
    got = {r.series_id: r for r in readers.read_tsf(spark, p).collect()}
    assert got["T1"].start == "2020-01-01 00-00-00" and got["T1"].x[:2] == [1, 2] and got["T2"].x == [3]
    assert readers.tsf_attributes(spark, p)["horizon"] == "7"


def test_npy_and_writers(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12, dtype="float32").reshape(2, 2, 3))
    panel = readers.read_npy(spark, str(tmp_path / "a.npy"))
    assert sorted(r.x for r in panel.collect()) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    writers.write_time_csv(panel, str(tmp_path / "out"), 2)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 6


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f4", ">f8", "<i2", "|u1", "|b1"])
@pytest.mark.parametrize("form", ["npy", "npz", "packed"])
def test_npy_files_by_ranges(spark, tmp_path, order, kind, form):
    """Ranges of several files, ids by (file, row)."""
    rng = np.random.default_rng(0)
    want = []
    for name, n in (("b", 7), ("a", 50), ("c", 0), ("d", 1)):
        a = np.asarray(rng.integers(0, 100, size=(n, 2, 3)), dtype=kind, order=order)
        a = np.asfortranarray(a) if order == "F" else a
        path = tmp_path / f"{name}.{'npy' if form == 'npy' else 'npz'}"
        np.save(path, a) if form == "npy" else (np.savez if form == "npz" else np.savez_compressed)(path, y=np.zeros(3), x=a)
        want.append((name, a))
    (tmp_path / "_half.npy").write_bytes(b"x")
    got = readers.read_npy(spark, str(tmp_path), None if form == "npy" else "x", partition_bytes=60)
    flat = np.concatenate([a for _, a in sorted(want, key=lambda w: w[0])]).astype(float)
    assert sorted((r.sample_id, r.var_id, r.x) for r in got.collect()) == [(i, v, flat[i, v].tolist()) for i in range(58) for v in range(2)]
    assert got.rdd.getNumPartitions() > 5 or form == "packed"


def test_one_large_npy_file_is_read_by_many_tasks(spark, tmp_path):
    a = np.arange(8 << 20, dtype="<f8").reshape(-1, 4, 64)
    np.save(tmp_path / "large.npy", a)
    got = readers.read_npy(spark, f"file://{tmp_path}/large.npy", partition_bytes=8 << 20)
    assert got.rdd.getNumPartitions() >= 8
    found = got.selectExpr("count(*) AS n", "count(DISTINCT sample_id) AS ids", "sum(x[63]) AS last").first()
    assert (found.n, found.ids, found.last) == (a.shape[0] * 4, a.shape[0], a[:, :, 63].sum())
    np.save(tmp_path / "flat.npy", np.ones((3, 5), dtype="<i8"))
    assert [r.x for r in readers.read_npy(spark, str(tmp_path / "flat.npy")).collect()] == [[1.0] * 5] * 3
    np.save(tmp_path / "bad.npy", np.array(["a"]))
    with pytest.raises(Exception, match="rank 2 or 3"):
        readers.read_npy(spark, str(tmp_path / "bad.npy")).collect()


def test_catalog_of_a_folder(spark, tmp_path):
    from panelwright.sources.catalog import catalog

    for name in ("Beef/Beef_TRAIN.tsv", "Beef/Beef_TEST.tsv", "Wind.tsf", "x_test.npz", "notes.txt", "_hidden.tsv", ".git/a.tsv", "wide.parquet/part-0.parquet", "wide.parquet/part-1.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    got = {(r.name, r.reader, r.split, r.files, r.bytes) for r in catalog(spark, str(tmp_path)).collect()}
    assert got == {("Beef", "read_tsv", "train", 1, 1), ("Beef", "read_tsv", "test", 1, 1), ("Wind", "read_tsf", None, 1, 1), ("x", "read_npy", "test", 1, 1), ("wide", "read_parquet", None, 2, 2)}
