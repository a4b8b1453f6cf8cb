"""The exact search at work: what a block of queries computes and holds, ties, crowds of equal vectors, one owner."""

import numpy as np
import pyarrow as pa
import pytest

from kindred.operators import vectors


def block(x, first, owner):
    at = range(first, first + len(x))
    return vectors._Block(pa.array([f"u{i:05d}" for i in at]), pa.array([owner(i) for i in at]), vectors._scaled(x.astype(float)))


def searched(x, owner, k, pre, size=100):
    top = vectors._Top(block(x, 0, owner), k, pre)
    for lo in range(0, len(x), size):
        top.add(block(x[lo : lo + size], lo, owner))
    return top


@pytest.mark.parametrize("pre", [True, False])
def test_best_of_odd_vectors(monkeypatch, pre):
    monkeypatch.setattr(vectors, "NAMES", 50)
    monkeypatch.setattr(vectors, "PAIRS", 7)
    r = np.random.RandomState(3)
    x = r.normal(size=(700, 16))
    x[:250] = x[0]  # equal vectors; those of one owner fill whole blocks
    x[300], x[301] = 0, np.nan
    owner = lambda i: "one" if i < 220 else f"o{i % 50}"
    unit = vectors._scaled(x)
    sims = np.round(unit @ unit.T, vectors.DIGITS)
    want = set()
    for i in range(700):
        able = [j for j in range(700) if np.isfinite(sims[i, j]) and not (pre and owner(i) == owner(j))]
        want |= {(f"u{i:05d}", f"u{j:05d}", sims[i, j]) for j in sorted(able, key=lambda j: (-sims[i, j], j))[:5]}
    got = searched(x, owner, 4, pre).rows()
    assert {(q, c, s) for q, c, s in zip(*(got.column(i).to_pylist() for i in (0, 2, 4)), strict=True)} == want


def test_few_pairs_are_computed_in_full(monkeypatch):
    merged = []
    merge = vectors._Top._merge
    monkeypatch.setattr(vectors._Top, "_merge", lambda self, row, at, sims: (merged.append(len(row)), merge(self, row, at, sims)))
    monkeypatch.setattr(vectors, "NAMES", 1000)
    top = searched(np.random.RandomState(4).normal(size=(8000, 32)), str, 10, True, 500)
    assert sum(merged) < 100 * 8000 and top.seen < 8000 * 11 * 2 + 1500


def test_rounded_keeps_the_sign_of_zero(spark):
    import math

    from kindred.functions.arrays import rounded

    rows = spark.createDataFrame([(x,) for x in (-1e-7, 1e-7, -0.0, -0.125, 2.5e-5, 1e300, math.nan, None)], "x double")
    got = [r.y for r in rows.select(rounded("x", 2).alias("y")).collect()]
    assert [str(y) for y in got] == ["-0.0", "0.0", "-0.0", "-0.13", "0.0", "1e+300", "nan", "None"]
