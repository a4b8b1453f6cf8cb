"""Review rows without a wide table, and pairs of large groups in tiles."""

from itertools import combinations

from kindred.operators import pairs, reports
from kindred.schema import KEYS


def listing(spark):
    """A scan with 40 candidates, scans with one, null and empty keys, one uid with two paths."""
    side = lambda u: ("d" + u[-1], "s" + u, None, "c" + u, "/p/" + u, u)
    rows = [(*side("hub"), *side(f"u{i:02d}"), 0.9 - i / 100, i + 1) for i in range(40)]
    rows += [(*side(f"u{i:02d}"), *side("hub"), 0.9 - i / 100, 1) for i in range(40)]
    rows += [(*side("x")[:4], "/q/x", "x", *side("y"), 0.5, 1), (*side("x"), *side("z"), 0.4, 2), ("", *side("w")[1:], *side("y"), 0.3, 1), (*side("v"), None, *side("y")[1:], 0.3, 1)]
    names = [f"{s}_{c} string" for s in ("query", "cand") for c in (*KEYS, "scan_uid")]
    return spark.createDataFrame(rows, ", ".join([*names, "similarity double", "slot long"]))


def test_rows_are_those_of_the_wide_table(spark):
    rows = listing(spark)
    want, got = pairs.review_long(pairs.review_wide(rows)), pairs.review_rows(rows)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert pairs.review_rows(rows.limit(0)).count() == 0


def test_pairs_of_a_large_group_come_from_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(reports, "TILE", 10)
    groups = [("g1", f"d{i % 3}|s{i:03d}") for i in range(95)] + [("g2", "d0|x"), ("g2", "d1|y"), ("g3", "d0|z")]
    table = spark.createDataFrame([(g, k, *k.split("|")) for g, k in groups], "group_id string, subject_key string, dataset string, subject_id string")
    axis = reports.near_axis(table)
    place = {r.subject_key: (r.idx, r.dataset) for r in axis.collect()}
    want = set()
    for g in ("g1", "g2"):
        for a, b in combinations([k for h, k in groups if h == g], 2):
            (x, dx), (y, dy) = sorted([place[a], place[b]])
            want.add((g, "within_dataset" if dx == dy else "across_datasets", x, y))
    found = reports.near_pair_points(table, axis)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parts = found.where("group_id = 'g1'").rdd.glom().map(len).collect()
    assert sum(p > 0 for p in parts) > 3
