"""The stored index against exact neighbours: all lists, few lists on clusters, extension, odd rows."""

import numpy as np
import pytest

from kindred.operators import vectors
from kindred.operators.vector_index import build_index, extend_index, open_index, search

SCHEMA = "uid string, owner string, embedding array<float>, cell int, code string"  # clashing extra columns


def table(spark, x, first=0, owner=lambda i: f"o{i // 2}"):
    return spark.createDataFrame([(f"u{first + i:05d}", owner(first + i), v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)


def pairs(found):
    return {(r.query, r["rank"]): (r.cand, round(r.similarity, 6)) for r in found.collect()}


@pytest.mark.parametrize("mode", ["pre", "post"])
def test_all_lists_give_exact_neighbours(spark, tmp_path, mode):
    r = np.random.RandomState(1)
    x = r.normal(0, 1, (1200, 16))
    x[5], x[7] = 0, x[6] * 3  # a zero vector, and one in another's direction
    rows = table(spark, x)
    path = str(tmp_path / "index")
    build_index(rows.limit(0).union(table(spark, x[:900])), path, 12)
    assert extend_index(open_index(spark, path), table(spark, x[850:], 850)) == 300
    index = open_index(spark, path)
    assert extend_index(index, table(spark, x[850:], 850)) == 0 and index.codes(spark).count() == index.vectors(spark).count() == 1200
    asked = rows.where("cast(substr(uid, 2) as int) % 50 = 0")
    got, want = pairs(search(index, asked, 10, 12, mode)), pairs(vectors.nearest(rows, 10, mode, asked))
    assert got == want


def test_few_lists_on_clusters(spark, tmp_path):
    r = np.random.RandomState(2)
    centres = r.normal(0, 1, (64, 24))
    x = centres[r.randint(0, 64, 4000)] + r.normal(0, 0.25, (4000, 24))
    rows = table(spark, x, owner=lambda i: str(i))
    index = build_index(rows, str(tmp_path / "index"), 64)
    asked = rows.where("cast(substr(uid, 2) as int) % 50 = 0")
    got = {(q, c) for (q, _), (c, _) in pairs(search(index, asked, 10, 1)).items()}
    want = {(q, c) for (q, _), (c, _) in pairs(vectors.nearest(rows, 10, "post", asked)).items()}
    one = len(got & want) / len(want)
    two = {(q, c) for (q, _), (c, _) in pairs(search(index, asked, 10, 2)).items()}
    assert one >= 0.85 and len(two & want) / len(want) >= 0.9, one


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "o", [1.0, 0.0]), ("a", "p", [0.0, 1.0]), ("b", None, [0.5, 0.5]), ("c", "q", None), (None, "q", [1.0, 1.0])], "uid string, owner string, embedding array<float>")
    with pytest.raises(ValueError):
        build_index(rows.where("uid = 'c'"), path, 2)
    index = build_index(rows, path, 5)
    assert {r.uid: r.owner for r in index.vectors(spark).collect()} == {"a": "o", "b": ""}
    with pytest.raises(ValueError):
        build_index(rows, path, 5)
    found = search(index, spark.createDataFrame([("x", "x", [2.0, 0.0]), ("y", "y", None)], "uid string, owner string, embedding array<float>"), 3, 9).collect()
    assert [(r.query, r.cand, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [("x", "a", 1), ("x", "b", 2)]
    with pytest.raises(Exception, match="in an index of 2"):
        extend_index(index, spark.createDataFrame([("z", "z", [1.0, 2.0, 3.0])], "uid string, owner string, embedding array<float>"))
    assert search(index, rows.where("false"), 3, 2).count() == 0


def test_codes_lose_nothing_in_close_clusters(spark, tmp_path):
    r = np.random.RandomState(4)
    centres = r.normal(0, 1, (4, 32))
    x = centres[r.randint(0, 4, 1200)] + r.normal(0, 0.004, (1200, 32))  # closer than 8-bit codes tell
    rows = table(spark, x)
    index = build_index(rows, str(tmp_path / "index"), 6)
    asked = rows.where("cast(substr(uid, 2) as int) % 50 = 0")
    assert pairs(search(index, asked, 10, 6, "pre")) == pairs(vectors.nearest(rows, 10, "pre", asked))
