"""How the exact search is dealt: a task for each block of queries, candidates in few large rows, few merges."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.operators import vectors


def test_each_block_is_a_task_and_meets_all_candidates_in_order(spark):
    n, blocks = 5000, 8
    v = spark.range(n).repartition(5).selectExpr("lpad(id, 5, '0') as uid", "concat('o', id % 9) as owner", "cast(lpad(id, 8, 'x') as binary) as vector")
    cands = v.select("*", F.lit(None).cast("string").alias("equal"), F.lit(1).cast("long").alias("sure"), F.lit(False).alias("own"))
    rows = vectors._dealt(v, cands, blocks).withColumn("at", F.spark_partition_id()).collect()
    assert len({r.at for r in rows}) == len({(r.at, r.qb) for r in rows}) == blocks
    asked = []
    for at in {r.at for r in rows}:
        here = [r for r in rows if r.at == at]
        assert [r.side for r in here] == sorted(r.side for r in here) and len(here) < 40
        uids = [[u for r in here if r.side == s for u in pa.ipc.open_stream(r["pack"]).read_next_batch().column(0).to_pylist()] for s in (0, 1)]
        assert uids[1] == [f"{i:05d}" for i in range(n)]
        asked += uids[0]
    assert sorted(asked) == [f"{i:05d}" for i in range(n)]


def test_candidates_of_a_pack_are_merged_at_once_from_parts_that_fit_the_cache(monkeypatch):
    merges, widths = [], []
    merge, matmul = vectors._Top._merge, np.matmul
    monkeypatch.setattr(vectors._Top, "_merge", lambda self, *x: (merges.append(1), merge(self, *x)))
    monkeypatch.setattr(np, "matmul", lambda a, b, **k: (widths.append(b.shape[1]), matmul(a, b, **k))[1])
    x = np.random.RandomState(8).normal(size=(2 * vectors.PACK, 16))
    names = pa.array([f"u{i:05d}" for i in range(len(x))])
    part = lambda lo, hi: vectors._Block(names[lo:hi], names[lo:hi], vectors._scaled(x[lo:hi]))
    top = vectors._Top(part(0, 300), 5, False)
    for lo in range(0, len(x), vectors.PACK):
        top.add(part(lo, lo + vectors.PACK))
    assert len(merges) <= 2 and max(widths) <= vectors.BLOCK
    sims = np.round(vectors._scaled(x[:300]) @ vectors._scaled(x).T, vectors.DIGITS)
    assert (np.argsort(-sims, axis=1, kind="stable")[:, :6] == top.at).all()  # all names are kept: places in the order of arrival
