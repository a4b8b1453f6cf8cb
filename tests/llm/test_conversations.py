"""Conversation repair against a plain search over all edits, with odd rows and long conversations."""

import functools
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from kindred.llm import conversations, registry

SCHEMA = "conv_id long, turn long, role string, text string, weight long, conv string, audit string"  # clashing extra columns
WHITE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", "y") for r in rows], SCHEMA)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute_repair(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]

    @functools.cache
    def search(i, said, inserted):
        """The least (cost, audit, turns) from row i on; said: the last two role initials, or the first."""
        ways = []
        fits = lambda c: re.fullmatch(r"s?(ua)*u?", said + c) is not None  # noqa: E731  begins something that the grammar has
        go = lambda c: (said + c)[-2:] if len(said + c) < 3 else {"a": "ua", "u": "uau"}[c][-3:]
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", said):
            ways.append((0, "", ()))
        if inserted < 3:
            ways += [(3 + c, "I" + a, (f"{r}:", *t)) for r in ("user", "assistant") if fits(r[0]) for c, a, t in [search(i, go(r[0]), inserted + 1)]]
        if i < len(rows):
            role, text = rows[i][1:]
            ways += [(4 + c, "D" + a, t) for c, a, t in [search(i + 1, said, 0)]]
            if faults[i] not in ("blank", "duplicate"):
                for edit, to, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if to[:1] and fits(to[0]):
                        ways += [(cost + 3 * (faults[i] == "truncated") + c, edit + a, (f"{to}:{text}", *t)) for c, a, t in [search(i + 1, go(to[0]), 0)]]
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, turns_ = search(0, "", 0)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(turns_).encode()).hexdigest(),
    )


def check(spark, rows, parts=3):
    docs = table(spark, rows).repartition(parts)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_conversations(conversations.damaged(docs)).collect()}
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    want = {c: brute_repair(brute_damage(x)) for c, x in own.items()}
    assert got == want
    return got


TEXTS = ["Yes.", "No!", "Why? ", "cut off", "", " \t", "é…", "Ünï?\n", " ", "a.b", None]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]


def test_random_conversations(spark):
    r = random.Random(1)
    rows = []
    for conv in range(400):
        for i in range(r.randrange(7)):
            turn = r.choice([i, i, i, 2 * i, 0, None])
            rows += [(conv, turn, r.choice(ROLES), r.choice(TEXTS) if r.random() < 0.5 else f"text {r.random()}.")] * r.choice([1, 1, 1, 2])
    got = check(spark, rows)
    assert {c for x in got.values() for c in x[6]} == set("DIKR")


def test_orderly_conversations(spark):
    rows = [(conv, i, ("system", "user", "assistant")[0 if i == 0 and conv % 2 else 1 + (i + conv) % 2], f"Turn {i} of {conv}.") for conv in range(200) for i in range(conv % 9)]
    check(spark, rows)


def test_odd_ids_and_dropped_conversations(spark):
    dropped = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = check(spark, [(dropped, 0, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (-5, 2**62, "user", "A."), (-5, -(2**40), "user", "B.")])
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_conversations(conversations.damaged(table(spark, []))).count() == 0


def faults_of(rows):
    seen = set()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        yield "gone" if not bare or (role, text) in seen else "cut" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def replayed(rows, audit):
    """Cost and digest of edits, which have to fit the rows and the grammar."""
    todo, cost, turns = iter(zip(rows, faults_of(rows), strict=True)), 0, []
    for edit in audit:
        role = "assistant" if turns and turns[-1][0][0] == "u" else "user"
        if edit == "I":
            cost += 3
            turns.append((role, ""))
            continue
        (_, own, text), fault = next(todo)
        if edit == "D":
            cost += 4
            continue
        assert fault != "gone"
        cost += 3 * (edit == "R") + 3 * (fault == "cut")
        turns.append((own if edit == "K" else role, text))
    assert next(todo, None) is None and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns))
    return cost, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def least_cost(rows):
    """By the last role initial so far ('' at the start), from the first row on."""
    may = {"": "su", "s": "u", "u": "a", "a": "u"}
    at = {"": 0}
    for (_, role, _), fault in [*zip(rows, faults_of(rows), strict=True), ((None, None, None), None)]:
        for _ in range(3):
            for last, c in list(at.items()):
                for to in may[last].replace("s", ""):
                    at[to] = min(at.get(to, 10**9), c + 3)
        if role is None:
            return min(at.get("", 10**9), at["a"])
        then = {last: c + 4 for last, c in at.items()}
        if fault != "gone":
            for last, c in at.items():
                for to in may[last]:
                    if to == role[:1] or to != "s":
                        then[to] = min(then.get(to, 10**9), c + 3 * (fault == "cut") + 3 * (to != role[:1]))
        at = then


def test_one_conversation_over_many_batches(spark):
    r = random.Random(2)
    n, roles = 30_000, ["user", "assistant"]
    rows = [(1, i, roles[i % 2] if r.random() < 0.9 else "user", f"text {r.randrange(3 * n)}.") for i in range(n)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y. " + " " * 2_000_000)]
    rows += [(3, 0, "user", "the same text.")] * 5000
    got = {x.conv_id: x for x in conversations.repair_conversations(conversations.damaged(table(spark, rows))).collect()}
    told = brute_damage([x for x in rows if x[0] == 1])
    assert (got[1].cost, got[1].repaired_sha256) == replayed(told, got[1].audit) and got[1].cost == least_cost(told)
    assert got[2].repaired_sha256 == brute_repair(brute_damage([x for x in rows if x[0] == 2]))[-1]
    assert got[3].duplicate == 5000 * (1 + (zlib.crc32(b"3:0") % 20 == 3)) - 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    got = {r.conv_id: tuple(r)[1:] for r in registry.op13_conversation_repair(spark, sf).collect()}
    assert got == {c: brute_repair(brute_damage(x)) for c, x in own.items()}
    assert registry.op13_conversation_repair(spark, sf).where(F.col("audit").rlike("[^DIKR]")).count() == 0
