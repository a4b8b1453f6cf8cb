"""Decisions as state: counts, timers, replays, bursts and compare-and-set, against sequential simulations."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from kindred.streaming import autosave

UPDATES = "path_1 string, path_2 string, revision long, qa_status string, reason string"
T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files of a stream are taken by time


def test_autosave_by_count_and_timer(spark, tmp_path):
    src, out, r = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(4)
    log = [(f"p{r.randrange(4)}", "q", k, r.choice(["yes", "no", "maybe"]), r.choice(["", "why", None])) for k in range(1, 40)]
    late = log[:]
    r.shuffle(late)  # arrives in any order
    late.insert(5, late[2])  # and repeated
    for k in range(0, len(late), 10):
        put(spark, src, late[k : k + 10], UPDATES)
    put(spark, src, [(None, "q", 1, "yes", ""), ("p0", "q", None, "yes", "")], UPDATES)

    def run(wait_ms, trigger):
        return autosave.autosaved(stream_of(spark, src, UPDATES), 3, wait_ms).writeStream.outputMode("update").foreachBatch(lambda b, e: b.withColumn("epoch", F.lit(e)).write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(**trigger).start()

    q, ends = run(10**9, {"processingTime": "100 milliseconds"}), time.time() + 60
    while time.time() < ends and sum(p["numInputRows"] for p in q.recentProgress) < len(late) + 2:  # a query with timers never ends
        time.sleep(0.3)
    q.stop()
    first = spark.read.parquet(out).collect()
    assert first and all(x.n_updates >= 3 for x in first)
    q = run(1, {"processingTime": "100 milliseconds"})  # the state goes on; a new update sets a timer
    put(spark, src, [(f"p{k}", "q", 100 + k, "yes", None) for k in range(4)], UPDATES)
    want = {}
    for p, _, k, status, reason in [*log, *[(f"p{k}", "q", 100 + k, "yes", None) for k in range(4)]]:
        want[p] = max(want.get(p, (0,)), (k, status, reason or ""))
    ends = time.time() + 60
    while time.time() < ends and {x.path_1: (x.revision, x.qa_status, x.reason) for x in autosave.saved(spark.read.parquet(out)).collect()} != want:
        time.sleep(0.5)
    q.stop()
    got = spark.read.parquet(out)
    assert {x.path_1: (x.revision, x.qa_status, x.reason) for x in autosave.saved(got).collect()} == want
    assert {x.path_1: x.revision for x in autosave.saved(got.union(got)).collect()} == {p: v[0] for p, v in want.items()}


def made_up(r, n):
    """Updates of three reviewers on three pairs, in bursts."""
    rows, clock = [], {}
    for _ in range(n):
        pair, who = f"p{r.randrange(3)}", f"r{r.randrange(3)}"
        t = clock.get((pair, who), r.randrange(2000)) + r.choice([10, 100, 299, 300, 301, 900])
        clock[pair, who] = t
        rows.append((pair, "q", who, T0 + dt.timedelta(milliseconds=t), r.randrange(4), len(rows), r.choice(["yes", "no", None]), r.choice(["", "x", None])))
    return rows


REVISED = "path_1 string, path_2 string, reviewer string, at timestamp, base long, revision long, qa_status string, reason string"


def simulated(rows):
    """Bursts by a pause of 300 ms, then compare and set in order."""
    bursts, own = [], {}
    for x in sorted(rows, key=lambda x: x[3]):
        own.setdefault((x[0], x[1], x[2]), []).append(x)
    for key, xs in own.items():
        held = []
        for x in [*xs, None]:
            if held and (x is None or x[3] - held[-1][3] > dt.timedelta(milliseconds=300)):
                revision, status, reason = max((h[5], h[6] or "", h[7] or "") for h in held)
                bursts.append((*key, min(h[4] for h in held), revision, status, reason, len(held), held[-1][3] + dt.timedelta(milliseconds=300)))
                held = []
            if x:
                held.append(x)
    now, out = {}, []
    for b in sorted(bursts, key=lambda b: (b[8], b[2], b[4])):
        ok = b[3] == now.get(b[:2], 0)
        if ok:
            now[b[:2]] = now.get(b[:2], 0) + 1
        out.append((*b, now[b[:2]] if ok else None))
    return sorted(out, key=str)


def told(rows):
    names = ("path_1", "path_2", "reviewer", "base", "revision", "qa_status", "reason", "n_updates", "ended", "stored")
    return sorted((tuple(r[c] for c in names) for r in rows), key=str)


def test_bursts_and_compare_and_set(spark):
    for seed in (1, 2):
        rows = made_up(random.Random(seed), 120)
        got = told(autosave.accepted(autosave.flushes(spark.createDataFrame(rows, REVISED).repartition(3))).collect())
        assert got == simulated(rows) and any(x[-1] for x in got) and any(x[-1] is None for x in got)
    assert autosave.accepted(autosave.flushes(spark.createDataFrame([], REVISED))).count() == 0


def test_out_of_order_stream_of_bursts(spark, tmp_path):
    src, out, r = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(3)
    rows = made_up(r, 90)
    shuffled = rows[:]
    r.shuffle(shuffled)
    for k in range(0, 90, 30):
        put(spark, src, shuffled[k : k + 30], REVISED)
    put(spark, src, [("end", "q", "r", T0 + dt.timedelta(days=1), 0, 0, "no", "")], REVISED)  # moves the watermark on
    put(spark, src, [("p0", "q", "r0", T0 - dt.timedelta(days=9), 0, 99, "no", "")], REVISED)  # too late
    q = autosave.flushes(stream_of(spark, src, REVISED), "1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = autosave.accepted(spark.read.parquet(out).where("path_1 <> 'end'")).collect()
    assert told(got) == simulated(rows)
