"""Tiles of the pair matrix, resampled volumes, numbers of Spark's tasks, and the last read of a path."""

import random

import numpy as np
from pyspark.sql import functions as F

from kindred.functions.arrays import resampled
from kindred.operators import exact, reports, volumes
from kindred.plans import audit
from kindred.plans.profile import Profiler


def test_tiles_of_a_large_group(spark):
    r = random.Random(1)
    rows = [("g0" if i < 700 else f"g{i % 40}", f"d{r.randrange(3)}", f"s{r.randrange(4)}", r.choice(["", "1", "2"]), f"/c{i}", f"/c{i}") for i in range(900)]
    base = spark.createDataFrame(rows, "group_id string, dataset string, subject_id string, session_id string, candidate string, resolved_path string")
    axis = reports.exact_axis(base).persist()
    tiles = reports.pair_tiles(base, axis, 16, 5).collect()
    place, size = {x.resolved_path: x.idx for x in axis.collect()}, -(-900 // 16)
    want = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0]:
                kind = "across_datasets" if a[1] != b[1] else "across_subjects" if a[2] != b[2] else "within_session" if not a[3] or not b[3] or a[3] == b[3] else "across_sessions"
                x, y = sorted((place[a[5]], place[b[5]]))
                for level in range(5):
                    k = (level, x // size >> level, y // size >> level, kind)
                    want[k] = want.get(k, 0) + 1
    assert {(t.level, t.x, t.y, t.category): t.n_pairs for t in tiles} == want
    counts = {x.category: x.n_pairs for x in reports.pair_category_counts(base).collect()}
    for level in range(5):
        assert {c: sum(t.n_pairs for t in tiles if t.level == level and t.category == c) for c in counts} == counts
    assert reports.pair_tiles(base.where("false"), axis.where("false")).count() == 0


def test_a_group_of_a_million_rows_makes_bounded_tiles(spark):
    rows = spark.range(1_000_000).select(F.lit("g").alias("group_id"), F.concat(F.lit("d"), F.col("id") % 2).alias("dataset"), F.lit("s").alias("subject_id"), F.lit("").alias("session_id"), F.col("id").cast("string").alias("candidate"), F.col("id").cast("string").alias("resolved_path"))
    axis = rows.select("resolved_path", F.col("resolved_path").cast("long").alias("idx"))
    tiles = reports.pair_tiles(rows, axis, 8, 1).collect()
    n = 1_000_000
    assert len(tiles) == 2 * 36 and sum(t.n_pairs for t in tiles) == n * (n - 1) // 2


def plain(v, affine, to_affine, shape, nearest, fill):
    out = np.full(shape, fill, float)
    for at in np.ndindex(*shape):
        x = np.round(np.linalg.inv(affine) @ to_affine @ [*at, 1.0], 9)[:3]
        get = lambda p: v[tuple(p)] if all(0 <= a < n for a, n in zip(p, v.shape, strict=True)) else fill
        low = np.floor(x).astype(int)
        if nearest:
            out[at] = get(np.floor(x + 0.5).astype(int))
        else:
            out[at] = sum(get(low + c) * np.prod([p if s else 1 - p for p, s in zip(x - low, c, strict=True)]) for c in np.ndindex(2, 2, 2))
    return out


def test_resampling_against_plain_version(spark):
    r = np.random.RandomState(3)
    v = r.randint(0, 5, (5, 4, 6)).astype(float)
    turn = np.linalg.qr(r.normal(0, 1, (3, 3)))[0]
    affines = [np.eye(4), np.block([[turn * 1.3, r.normal(0, 2, (3, 1))], [np.zeros((1, 3)), 1]]), np.diag([-2.0, 0.5, 1.0, 1.0])]
    for a in affines:
        for b in affines:
            for nearest in (True, False):
                for fill in (0.0, -7.0):
                    got = resampled(v, a, b, (4, 5, 3), nearest, fill)
                    assert np.allclose(got, plain(v, a, b, (4, 5, 3), nearest, fill))
    assert np.array_equal(resampled(v, np.eye(4), np.eye(4), v.shape), v)
    labels = resampled(v.astype(np.int16), affines[1], np.eye(4), (6, 6, 6), True)
    assert labels.dtype == np.int16 and set(np.unique(labels)) <= {0, 1, 2, 3, 4}
    flat = affines[1].ravel().tolist()
    rows = [(1, [5, 4, 6], flat, v.ravel().tolist(), True, "x"), (2, [5, 4, 6], flat, v.ravel().tolist(), None, "y"), (3, [5, 4], flat, [1.0], True, None), (4, None, flat, [1.0], True, None), (5, [1, 1, 1], [0.0] * 16, [1.0], False, None), (6, [1, 1, 1], flat, None, False, None)]
    df = spark.createDataFrame(rows, "id long, shape array<int>, affine array<double>, voxels array<double>, labels boolean, i string")
    got = {x.id: x for x in volumes.onto_grid(df, np.eye(4), (4, 5, 3)).collect()}
    assert np.allclose(got[1].voxels, plain(v, affines[1], np.eye(4), (4, 5, 3), True, 0).ravel()) and np.allclose(got[2].voxels, plain(v, affines[1], np.eye(4), (4, 5, 3), False, 0).ravel())
    assert [got[k].voxels for k in (3, 4, 5, 6)] == [None] * 4 and got[1].shape == [4, 5, 3] and got[1].i == "x"
    assert volumes.onto_grid(df.where("false"), np.eye(4), (2, 2, 2)).count() == 0


def test_numbers_of_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    p = Profiler(spark=spark)
    with p.stage("whole"):
        with p.stage("write"):
            spark.range(1000).repartition(3, "id").write.parquet(path)
        with p.stage("read"):
            assert spark.read.parquet(path).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
        with p.stage("nothing"):
            pass
    spark.range(5).count()  # outside
    got = {r.stage_name: r for r in p.stages(spark).collect()}
    assert got["write"].rows_written == 1000 and got["write"].shuffle_rows == 1000 and got["read"].rows_read == 1000 and got["read"].rows_written == 0
    assert got["write"].executor_cpu_s > 0 and got["write"].bytes_written > 0 and got["nothing"].n_tasks == 0
    for c in ("rows_read", "rows_written", "shuffle_bytes", "n_tasks"):
        assert got["whole"][c] == got["write"][c] + got["read"][c]
    assert Profiler().stages(spark).count() == 0


def test_the_last_read_counts(spark, tmp_path):
    rows = [("/a", "h1", None, "2024-01-01", "2024-01-02 00:00:00"), ("/a", "h0", None, "2024-01-01", "2024-01-03 00:00:00"), ("/a", None, "IOError", None, "2024-01-04 00:00:00"), ("/b", None, "IOError", None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "resolved_path string, raw_hash string, error string, mtime string, read_at string").withColumn("read_at", F.to_timestamp("read_at"))
    df.write.parquet(str(tmp_path / "hashes"))
    catalog = spark.createDataFrame([("d", "s", "", p, p) for p in ("/a", "/b", "/c")], "dataset string, subject_id string, session_id string, candidate string, resolved_path string")
    got = {r.resolved_path: (r.raw_hash, r.error) for r in audit.current_facts(spark, str(tmp_path), catalog).collect()}
    assert got == {"/a": ("h0", None), "/b": (None, "IOError")}
    uid = {r.resolved_path: r.scan_uid for r in exact.near_input(catalog, catalog.where("false"), df).collect()}
    assert uid == {"/a": "h0"}
