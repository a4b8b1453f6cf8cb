"""Matrices as .npy: files that NumPy reads and wrote, ranges, faults, and tasks that fail half-way."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.sources import npy, tables


def test_round_trip_and_ranges(spark, tmp_path):
    x = np.random.RandomState(1).normal(0, 1, (1001, 7)).astype(np.float32)
    rows = spark.createDataFrame([(i, row.tolist(), "x") for i, row in enumerate(x)], "emb_row long, embedding array<float>, hidden string").repartition(6)
    path = npy.write_npy(rows, str(tmp_path / "a" / "m.npy"))
    assert np.array_equal(np.load(path), x) and os.listdir(tmp_path / "a") == ["m.npy"]
    back = npy.read_npy(spark, path, 28 * 100)
    assert back.rdd.getNumPartitions() == 11
    got = {r.emb_row: r.embedding for r in back.collect()}
    assert np.array_equal(np.array([got[i] for i in range(1001)], np.float32), x)
    assert npy.read_npy(spark, f"file://{path}").count() == 1001
    again = npy.write_npy(rows.where("emb_row < 3"), path)  # takes the old one's place
    assert np.load(again).shape == (3, 7)


@pytest.mark.parametrize("dtype", ["<f8", ">f4", "<i2", "<u1", "<f2"])
def test_matrices_of_numpy(spark, tmp_path, dtype):
    x = np.random.RandomState(2).randint(0, 200, (40, 3)).astype(dtype)
    np.save(tmp_path / "m.npy", x)
    got = npy.read_npy(spark, str(tmp_path / "m.npy")).orderBy("emb_row").collect()
    assert [r.embedding for r in got] == x.astype(np.float32).tolist()


def test_odd_files(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    np.save(at("none.npy"), np.zeros((0, 5), np.float32))
    assert npy.read_npy(spark, at("none.npy")).count() == 0
    empty = npy.write_npy(spark.createDataFrame([], "emb_row long, embedding array<float>"), at("empty.npy"))
    assert np.load(empty).shape == (0, 0)
    for name, x in (("flat", np.zeros(5)), ("cube", np.zeros((2, 2, 2))), ("columns", np.asfortranarray(np.zeros((4, 3)))), ("text", np.array([["a"]]))):
        np.save(at(name + ".npy"), x)
        with pytest.raises(ValueError):
            npy.read_header(at(name + ".npy"))
    np.save(at("cut.npy"), np.zeros((10, 4)))
    with open(at("cut.npy"), "r+b") as f:
        f.truncate(300)
    with pytest.raises(ValueError, match="ends before"):
        npy.read_header(at("cut.npy"))
    with pytest.raises(ValueError, match="local or mounted"):
        npy.write_npy(spark.createDataFrame([(0, [1.0])], "emb_row long, embedding array<float>"), "hdfs://x/m.npy")


def test_rows_that_are_no_matrix(spark, tmp_path):
    bad = [[(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, None)], [(None, [1.0])], [(1, [1.0])]]
    for rows in bad:
        with pytest.raises(ValueError):
            npy.write_npy(spark.createDataFrame(rows, "emb_row long, embedding array<float>"), str(tmp_path / "m.npy"))
        assert os.listdir(tmp_path) == []


def test_a_failing_task_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "m.npy")
    np.save(path, np.ones((2, 2)))
    rows = spark.range(50).select(F.col("id").alias("emb_row"), F.when(F.rand() < 2, F.array(F.lit(1.0), F.lit(2.0))).alias("embedding"))
    writer = npy.NpyWriter({"path": path, "hidden": str(tmp_path / "h"), "rows": "50", "width": "2", "start": "128"})
    open(tmp_path / "h", "wb").close()
    with pytest.raises(ValueError, match="49 of 50"):
        writer.commit([npy.Written(20), None, npy.Written(29)])
    assert sorted(os.listdir(tmp_path)) == ["m.npy"] and np.load(path).shape == (2, 2)
    poison = F.udf(lambda i: 1 // (i - 40) and [1.0, 2.0], "array<float>")
    with pytest.raises(Exception):  # noqa: B017
        npy.write_npy(rows.withColumn("embedding", poison("emb_row")), path)
    assert sorted(os.listdir(tmp_path)) == ["m.npy"] and np.load(path).shape == (2, 2)


def test_manifest_and_matrix(spark, tmp_path):
    np.save(tmp_path / "e.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    manifest = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2)], "scan_uid string, emb_row long")
    got = {r.scan_uid: r.embedding for r in tables.read_embeddings(spark, str(tmp_path / "e.npy"), manifest).collect()}
    assert got == {"a": [0, 1], "b": [2, 3], "c": [4, 5]}
    with pytest.raises(ValueError, match="3 rows, the manifest 2"):
        tables.read_embeddings(spark, str(tmp_path / "e.npy"), manifest.limit(2))
    with pytest.raises(ValueError, match="no names"):
        tables.read_embeddings(spark, str(tmp_path / "e.npy"))
