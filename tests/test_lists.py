"""Search by lists: a query keeps its best over all lists it looks at, ties and owners as in the exact search."""

import numpy as np
import pytest

from kindred.operators import vectors

K, LISTS, PROBES = 4, 8, 3
SCHEMA = "uid string, owner string, embedding array<float>"


def rows_of():
    """Random vectors, zero vectors (they tie with all), crowds of equal and pairs of parallel ones, of one and of many owners."""
    r = np.random.RandomState(5)
    x = r.normal(size=(400, 6)).astype(np.float32)
    x[:40], x[40:70], x[70:74] = x[0], x[40], 0
    x[80:90] = 2 * x[90:100]
    names = r.permutation(len(x))
    return [(f"u{n:03d}", "one" if i < 30 else f"o{i % 60}", [float(v) for v in row]) for i, (n, row) in enumerate(zip(names, x, strict=True))]


def brute(rows, centres, pre, asked=lambda uid: True):
    x = vectors._scaled(np.array([r[2] for r in rows], np.float32).astype(float))
    sims = np.round(x @ x.T, vectors.DIGITS)
    cells = np.argsort(-(x @ centres.T), axis=1, kind="stable")
    want = set()
    for i, (q, owner, _) in enumerate(rows):
        near = [j for j in range(len(rows)) if cells[j, 0] in cells[i, :PROBES]]
        found = sorted((-sims[i, j], rows[j][0], rows[j][1]) for j in near if not pre or (rows[j][0] != q and rows[j][1] != owner))
        if not pre:
            found = [f for f in found[: K + 1] if f[1] != q and f[2] != owner]
        want |= {(q, c, n + 1) for n, (_, c, _) in enumerate(found[:K]) if asked(q)}
    return want


@pytest.mark.parametrize("mode", ["pre", "post"])
def test_best_of_the_lists_looked_at(spark, monkeypatch, mode):
    monkeypatch.setattr(vectors, "LEAST_QUERIES", 40)
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    centres = vectors.centroids(df, LISTS, 400)
    got = lambda **more: {(r.query, r.cand, r.rank) for r in vectors.nearest_by_lists(df, K, LISTS, PROBES, 400, mode, 1, **more).collect()}
    assert got() == brute(rows, centres, mode == "pre")
    assert got(queries=df.where("uid < 'u050'")) == brute(rows, centres, mode == "pre", lambda uid: uid < "u050")


def test_all_lists_are_the_exact_search(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).selectExpr("uid", "owner", "transform(embedding, v -> v + 1e-9d * length(owner)) as embedding")
    exact = {(r.query, r.cand, r.rank, r.similarity) for r in vectors.nearest(df, K, "pre").collect()}
    assert {(r.query, r.cand, r.rank, r.similarity) for r in vectors.nearest_by_lists(df, K, LISTS, LISTS, 400, "pre", 1).collect()} == exact


def test_rows_to_rank_are_few_however_long_the_lists_are(spark, monkeypatch):
    ranked, seen = vectors._ranked, []
    monkeypatch.setattr(vectors, "_ranked", lambda found, *x: (seen.append(found), ranked(found, *x))[1])
    n = 5000
    df = spark.range(n).selectExpr("lpad(id, 5, '0') as uid", "concat('o', id) as owner", "transform(sequence(1, 8), i -> cast(sin(i * (1 + id)) as float)) as embedding")
    vectors.nearest_by_lists(df, K, 2, 2, n, "pre", 1)
    assert 0 < seen[0].count() <= n * (K + 1)


def test_ties_go_by_place_not_by_arrival():
    r = np.random.RandomState(6)
    x = vectors._scaled(np.repeat(r.normal(size=(30, 5)), 20, axis=0))
    place = r.permutation(len(x))
    names = np.array([f"u{p:03d}" for p in place])
    block = lambda at: vectors._Block(vectors.pa.array(names[at]), vectors.pa.array(names[at]), x[at], place=place[at])
    top = vectors._Top(block(np.arange(len(x))), K, False)
    for lo in range(0, len(x), 70):
        top.add(block(np.arange(lo, min(len(x), lo + 70))))
    sims = np.round(x @ x.T, vectors.DIGITS)
    want = [np.sort(place[np.lexsort((place, -s))[: K + 1]]) for s in sims]
    assert (np.sort(top.place, axis=1) == np.array(want)).all()
