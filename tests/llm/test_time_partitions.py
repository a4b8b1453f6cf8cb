"""Time partitions against a plain planner: files, order, what stays and what is rewritten, odd rows, repeated rows."""

import datetime as dt
import hashlib
import json
import random
import zlib

import pyarrow.parquet as pq
import pytest

from kindred.llm import registry, time_partitions
from kindred.plans import numbering
from kindred.plans.stored import new_path

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, m string, in_leaf string, l double, r map<string,int>"  # clashing extra columns
CUT = dt.datetime(2024, 4, 1)
ORDER = ("arrived_at", "click_id")


def first_key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def brute_plan(moments, limit):
    """Leaf names by (year, month, day, hour) prefix, as a function of a moment."""
    names = {}
    if not moments:
        return names
    count = lambda p: sum((t.year, t.month, t.day, t.hour)[: len(p)] == p for t in moments)
    def walk(parent, members):
        run, n = None, 0
        for m in members:
            p = (*parent, m)
            c = count(p)
            if c > limit and len(p) < 4:
                run = None
                last = {1: 12, 2: (dt.date(p[0] + p[1] // 12, p[1] % 12 + 1, 1) - dt.timedelta(1)).day if len(p) == 2 else 0, 3: 23}[len(p)]
                walk(p, range(0 if len(p) == 3 else 1, last + 1))
            elif c > limit:
                run = None
                names[p] = [m, m]
            elif run is not None and n + c <= limit:
                run[1], n = m, n + c
                names[p] = run
            else:
                run, n = [m, m], c
                names[p] = run
    walk((), range(min(moments).year, max(moments).year + 1))
    return names


def leaf_of(names, t):
    if t is None:
        return "null"
    full = (t.year, t.month, t.day, t.hour)
    p = next(full[:k] for k in (1, 2, 3, 4) if full[:k] in names)
    digits = lambda k, v: f"{v:04d}" if k == 0 else f"{v:02d}"
    return "/".join([digits(k, v) for k, v in enumerate(p[:-1])] + ["-".join(digits(len(p) - 1, v) for v in names[p])])


def brute_files(rows, limit):
    """(leaf, part) -> rows in order; rows: tuples that begin with moment, arrived_at and click_id."""
    names = brute_plan([r[0] for r in rows if r[0] is not None], limit)
    leaves = {}
    for r in rows:
        leaves.setdefault(leaf_of(names, r[0]), []).append(r)
    out = {}
    for leaf, own in leaves.items():
        own.sort(key=lambda r: first_key(r[:3]))
        for k in range(0, len(own), limit):
            out[leaf, k // limit + 1] = own[k : k + limit]
    return out


def rest(r):
    return json.dumps(r[3:], default=str)


def check(layout, before, now, columns):
    """The files of a layout hold exactly `now` as the plain planner lays it out; `before`: the rows there were, and the old files' paths."""
    old, new = brute_files(before[0], layout.limit), brute_files(now, layout.limit)
    late = list(map(repr, now))
    for r in map(repr, before[0]):
        late.remove(r)
    got = {(r.leaf, r.part): r for r in layout.files.collect()}
    assert set(got) == set(new)
    for key, own in new.items():
        r = got[key]
        t = pq.ParquetFile(r.path.removeprefix("file:")).read()
        assert t.column_names == columns
        ids = t.column("click_id").to_pylist()
        assert ids == [x[2] for x in own] and t.column("arrived_at").to_pylist() == [x[1] for x in own]
        assert r.ids_sha256 == hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest() and r.n_rows == len(own)
        same = sorted(map(repr, old.get(key, []))) == sorted(map(repr, own))
        assert r.rewritten == (not same) and (not same or r.path == before[1][key]), key
        assert r.n_new == sum(repr(x) in late for x in own)
    return {k: r.path for k, r in got.items()}, sorted(r.path.removeprefix("file:") for r in got.values())


def data_files(folder):
    import os

    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder.removeprefix("file:")) for f in fs if f.endswith(".parquet"))


def table(spark, rows):
    return spark.createDataFrame([(i, t, a, "x", leaf, v, {"k": 1, "j": None}) for t, a, i, leaf, v in rows], SCHEMA)


def run(spark, starting, late, limit):
    folder = new_path(spark, "test-clicks")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    plain = lambda rows: [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    a = time_partitions.create_layout(table(spark, starting), folder, limit, "ts", ORDER)
    paths, names = check(a, ([], {}), plain(starting), columns)
    assert data_files(folder) == names
    b = time_partitions.add_rows(time_partitions.open_layout(spark, folder, 0), table(spark, late))
    _, names = check(b, (plain(starting), paths), plain(starting + late), columns)
    assert data_files(folder) == names
    return b


def clicks(r, n, arrived, spans):
    out = []
    for _ in range(n):
        lo, seconds = r.choice(spans)
        t = None if r.random() < 0.1 else lo + dt.timedelta(seconds=r.randrange(seconds), microseconds=r.choice([0, 1, 999999]))
        out.append((t, arrived + dt.timedelta(seconds=r.randrange(50)), r.choice([r.randrange(10**6), 7, None]), r.choice(["a", None]), r.choice([0.5, None])))
        if r.random() < 0.1:
            out.append(out[-1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows(spark, seed):
    r = random.Random(seed)
    spans = [(dt.datetime(2024, 3, 5, 6), 7200), (dt.datetime(2024, 3, 1), 40 * 86400), (dt.datetime(1998, 1, 1), 20 * 365 * 86400), (dt.datetime(2023, 2, 1), 86400)]
    starting, late = clicks(r, 500, dt.datetime(2024, 3, 9), spans), clicks(r, 60, dt.datetime(2024, 4, 9), spans[:2])
    run(spark, starting, late, 8)


def test_parts_before_new_rows_stay_and_equal_rows_shift(spark):
    t, a = dt.datetime(2024, 3, 5, 6, 30), dt.datetime(2024, 3, 9)
    hot = [(t + dt.timedelta(seconds=i), a, i, "a", 0.5) for i in range(40)]
    same = [(None, a, 1, "a", 0.5)] * 30
    early, after = (t - dt.timedelta(seconds=1), a, 99, "b", 1.0), (t + dt.timedelta(seconds=35, milliseconds=5), CUT, 98, "b", 1.0)
    b = run(spark, hot + same, [after, (None, a - dt.timedelta(1), 0, "a", 0.5)], 5)
    told = {(r.leaf, r.part): r.rewritten for r in b.files.collect()}
    assert [told["2024/03/05/06-06", k] for k in range(1, 10)] == [False] * 7 + [True] * 2
    assert [told["null", k] for k in range(1, 8)] == [True] + [False] * 5 + [True]  # one equal row more at the front: the parts between recur
    run(spark, hot + same, [early], 5)
    run(spark, hot, [], 5)
    run(spark, [], hot + same, 5)
    run(spark, [], [], 1)


def test_large_leaves_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SMALL_ROWS", 20)
    r = random.Random(6)
    starting = [(dt.datetime(2024, 3, 5, 6, r.randrange(3)), dt.datetime(2024, 3, 9), r.randrange(5), "a", 0.5) for _ in range(300)] + [(None, None, None, None, None)] * 70
    run(spark, starting, [(dt.datetime(2024, 3, 5, 6, 1), CUT, 3, "a", 0.5)] * 3 + [(None, CUT, None, None, None)] * 9, 7)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/clicks.parquet")
    limit = 1 + rows.count() // 800
    plain = []
    for r in rows.collect():
        k, t = zlib.crc32(str(r.click_id).encode()) % 128, r.ts
        if t is not None:
            t = t - dt.timedelta(days=(k + 6) ** 3) if k < 16 else dt.datetime.combine(t.date() - dt.timedelta(t.weekday()), dt.time()) if k > 111 else t
        plain.append((t, r.arrived_at, r.click_id))
    found = {(r.leaf, r.part): r for r in registry.op12_time_partitions(spark, sf).collect()}
    old = brute_files([x for x in plain if x[1] is not None and x[1] < CUT], limit)
    new = brute_files(plain, limit)
    assert set(found) == set(new)
    for key, own in new.items():
        r = found[key]
        assert r.ids_sha256 == hashlib.sha256(",".join(str(x[2]) for x in own).encode()).hexdigest() and r.n_rows == len(own) and r["columns"] == ",".join(rows.columns)
        assert r.rewritten == (old.get(key) != own) and r.n_new == sum(x[1] is None or x[1] >= CUT for x in own)
    assert spark.read.parquet(*[r.path for r in found.values()]).exceptAll(rows).count() == 0
    assert 0 < sum(not r.rewritten for r in found.values()) < len(found)
