"""Rows of one vector are one candidate of the search: its results stay, ties, owners and crowds included."""

import numpy as np
import pytest

from kindred.operators import vectors

K = 4


def rows_of(seed):
    """Crowds of equal vectors of one, two and many owners, and parallel vectors, which tie with other ones."""
    r = np.random.RandomState(seed)
    kinds = [(r.normal(size=6)).astype(np.float32) for _ in range(12)]
    kinds += [(2 * x).astype(np.float32) for x in kinds[:5]] + [(0.5 * x).astype(np.float32) for x in kinds[:3]]
    own = [lambda: "one", lambda: f"two{r.randint(2)}", lambda: f"o{r.randint(40)}", lambda: "one" if r.rand() < 0.8 else f"o{r.randint(3)}"]
    out = []
    for i in r.permutation(240):
        j = 0 if r.rand() < 0.4 else r.randint(len(kinds))
        out.append((f"u{i:03d}", own[(j + seed) % 4](), [float(v) for v in kinds[j]]))
    return out + [(f"w{i:03d}", f"o{i % 7}", [float(v) for v in r.normal(size=6).astype(np.float32)]) for i in range(60)]


def brute(rows, pre):
    x = vectors._scaled(np.array([r[2] for r in rows], np.float32).astype(float))
    sims, want = np.round(x @ x.T, vectors.DIGITS), set()
    for i, (q, owner, _) in enumerate(rows):
        found = sorted((-sims[i, j], c, o) for j, (c, o, _) in enumerate(rows) if not pre or (c != q and o != owner))
        if not pre:
            found = [f for f in found[: K + 1] if f[1] != q and f[2] != owner]
        want |= {(q, c, n + 1) for n, (_, c, _) in enumerate(found[:K])}
    return want


@pytest.mark.parametrize("mode", ["pre", "post"])
@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_results_stay(spark, mode, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "uid string, owner string, embedding array<float>").repartition(3)
    assert {(r.query, r.cand, r.rank) for r in vectors.nearest(df, K, mode).collect()} == brute(rows, mode == "pre")


def test_copies_are_compared_once(spark, monkeypatch):
    df = spark.range(3000).selectExpr("lpad(id, 5, '0') as uid", "concat('o', id % 100) as owner", "transform(sequence(1, 8), i -> cast(sin(i * (1 + id % 30)) as float)) as embedding")
    coded = df.mapInArrow(lambda it: vectors._coded(it, "float32"), "uid string, owner string, vector binary")
    cands, shown = vectors._classes(coded, K, True)
    assert cands.count() <= 2 * 30 and shown.count() <= 30 * 2 * (K + 1)
    assert vectors._classes(coded.limit(30), K, False)[1] is None
