"""Least repair of damaged conversations.

Rows of a conversation are taken by turn. A row's fault is the first that holds: blank (nothing
but white space), duplicate (role and text seen earlier), truncated (the text doesn't end with a
sign that ends a sentence). Edits make the role initials fit the grammar `(s?(ua)+)?`: Keep costs
0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty text of user or assistant) 3; blank
and duplicate rows have to be deleted, truncated rows that stay cost 3 more.

 1. Equal rows (conversation, turn, role, text) are counted before anything is shuffled by
    conversation; all but the first are duplicates. A row whose role and text have an earlier turn
    is one too: the least turn of each role and text is an aggregate that is joined back.
 2. Rows are dealt by conversation and sorted backward. A dynamic program from the end holds, for
    each state of the grammar, the least cost of all that follows; every row gets the costs after it.
 3. The same partitions are sorted forward. A walk takes, among the edits that keep to the least
    cost, the one whose initial comes first in ASCII, and feeds the repaired turns to a digest.

Both passes stream: they hold one Arrow batch, four costs and the edits of one conversation (a
byte each, as the result has them), however long a conversation is. In a state of the grammar only
one of user and assistant can follow, so initials and costs determine the edits.

Defined results: null roles, texts, turns and conversation ids read as one space where they are
text; null turns come first; null ids are one conversation. Rows of one turn come in the order of
role and text. Any other role than those of the grammar, by its initial, can't be kept. Rows of
weight 0 count for nothing, but their conversation is returned. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import bounded_batches

# The grammar's states and what each may be followed by, costs of edits, signs that end a sentence, white space.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS, WHITE = ".!?", "\x20\t\n\x0b\x0c\r"

#: What user or assistant leads to from each state: role initial and state.
FREE = tuple(next((c, to) for c, to in follow.items() if c in ROLES) for follow in NEXT)
#: Costs at the end of a conversation, in the order of the states.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Rows of an output batch.
ROWS = 512


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and weight: rows with the faults that the crc32 of `conv:turn` modulo 20 deals.

    0 drops a row (weight 0), 1 empties its text, 2 removes signs that end sentences, 3 repeats
    it (weight 2), 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), deal.alias("deal"))
    role = F.when(F.col("deal") == 4, "user").when(F.col("deal") == 0, "").otherwise(F.col("role"))
    text = F.when(F.col("deal").isin(0, 1), "").when(F.col("deal") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    weight = F.when(F.col("deal") == 0, 0).when(F.col("deal") == 3, 2).otherwise(1).cast("long")
    return base.select("conv", "turn", role.alias("role"), text.alias("text"), weight.alias("weight"))


def row_fault(text: str, seen: bool) -> str:
    """'b'lank, 'd'uplicate, 't'runcated or nothing."""
    bare = text.rstrip(WHITE)
    return "b" if not bare else "d" if seen else "t" if bare[-1] not in ENDS else ""


def cheapest(after: tuple[int, ...], initial: str, fault: str) -> tuple[int, ...]:
    """Least costs from before a row on, by state; after: those from behind it on."""
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if fault not in ("b", "d"):
            extra = TRUNCATED if fault else 0
            if initial in NEXT[state]:
                best = min(best, extra + after[NEXT[state][initial]])
            best = min(best, extra + RE_ROLE + after[FREE[state][1]])
        out.append(best)
    # inserted turns: user and assistant follow each other, all else leads to user
    out[USER], out[ASSISTANT] = min(out[USER], INSERT + out[ASSISTANT]), min(out[ASSISTANT], INSERT + out[USER])
    return (min(out[START], INSERT + out[USER]), min(out[SYSTEM], INSERT + out[USER]), out[USER], out[ASSISTANT])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COSTED = (("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("weight", pa.int64()), ("fault", pa.string()), ("after", pa.list_(pa.int64())))
_RESULT = (*((x, pa.int64()) for x in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string()))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == ROWS or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _streamed(walk: Callable[[Iterator[tuple]], Iterator[tuple]], name: str, fields: tuple) -> Callable:
    """walk as a function of a task's batches; the first column keeps its type."""

    def run(batches):
        for first in batches:
            schema = pa.schema([(name, first.schema.field(0).type), *fields])
            yield from _batches(walk(_rows(itertools.chain([first], batches))), schema)

    return run


def _backward(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv, turn, role, text, weight, seen) of whole conversations from the last to the first, each with its fault and the costs behind its first copy."""
    now, costs = object(), AT_END
    for conv, turn, role, text, weight, seen in rows:
        if conv != now:
            now, costs = conv, AT_END
        fault = row_fault(text, seen)
        if weight:
            costs = tuple(c + DELETE * (weight - 1) for c in costs)  # copies go
        yield conv, turn, role, text, weight, fault, list(costs)
        if weight:
            costs = cheapest(costs, role[:1], fault)


class _Repair:
    """Walks forward over one conversation."""

    def __init__(self, conv):
        self.conv, self.state, self.cost = conv, START, 0
        self.count = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.last, self.turns, self.ends = 0, None, 0, (None, None)
        self.audit, self.digest, self.empty = bytearray(), hashlib.sha256(), True

    def _turn(self, role: str, text: str) -> None:
        self.digest.update((("" if self.empty else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.empty = False

    def _insert(self) -> None:
        initial, self.state = FREE[self.state]
        self.audit += b"I"
        self.cost += INSERT
        self._turn(ROLES[initial], "")

    def row(self, turn, role: str, text: str, weight: int, fault: str, after: list[int]) -> None:
        if not weight:
            return
        if turn is not None and turn != self.ends[1]:
            self.turns += 1
            self.ends = (turn if self.ends[0] is None else self.ends[0], turn)
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (weight - 1) * (2 * initial not in LEGAL)
        self.last = initial
        if fault:
            self.count[fault] += 1
        self.count["b" if fault == "b" else "d"] += weight - 1
        gone, extra = fault in ("b", "d"), TRUNCATED if fault == "t" else 0
        behind, before = tuple(after), cheapest(tuple(after), initial, fault)
        while True:  # initials in the order D, I, K, R
            least = before[self.state]
            if least == DELETE + behind[self.state]:
                self.audit += b"D"
                self.cost += DELETE
            elif least == INSERT + before[FREE[self.state][1]]:
                self._insert()
                continue
            elif not gone and initial in NEXT[self.state] and least == extra + behind[NEXT[self.state][initial]]:
                self.audit += b"K"
                self.cost += extra
                self.state = NEXT[self.state][initial]
                self._turn(role, text)
            else:
                self.audit += b"R"
                self.cost += extra + RE_ROLE
                initial, self.state = FREE[self.state]
                self._turn(ROLES[initial], text)
            break
        self.audit += b"D" * (weight - 1)
        self.cost += DELETE * (weight - 1)

    def result(self) -> tuple:
        while self.state not in (START, ASSISTANT):
            self._insert()
        gaps = 0 if self.ends[0] is None else self.ends[1] - self.ends[0] + 1 - self.turns
        return self.conv, gaps, self.count["b"], self.count["d"], self.count["t"], self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest()


def _forward(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The result of each conversation; its rows come in order."""
    walk = None
    for conv, *row in rows:
        if walk is None or walk.conv != conv:
            if walk is not None:
                yield walk.result()
            walk = _Repair(conv)
        walk.row(*row)
    if walk is not None:
        yield walk.result()


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    rows: conv, turn, role, text and weight, as `damaged` makes them; weight: how often a row is there.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv"].dataType.simpleString()
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("weight").alias("weight"))
    key = F.sha2(F.col("text").cast("binary"), 256)
    first = rows.where("weight > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), key.alias("k")).agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (key == F.col("k"))
    seen = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False))
    faulty = counted.join(first, same, "left").select("conv", "turn", "role", "text", "weight", seen.alias("seen"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv", "turn", "role", "text")
    # the digest and the edits of a conversation are one sequence each, so its rows meet in one task, which streams them
    back = bounded_batches(faulty.repartition(n, "conv").sortWithinPartitions(*[F.desc(c) for c in order]))
    costed = back.select(*order, "weight", "seen").mapInArrow(_streamed(_backward, "conv", _COSTED), f"conv {kind}, turn long, role string, text string, weight long, fault string, after array<long>")
    out = f"`{conv_col}` {kind}, " + ", ".join(f"{x} long" for x in NUMBERS) + ", audit string, repaired_sha256 string"
    return costed.sortWithinPartitions(*order).mapInArrow(_streamed(_forward, conv_col, _RESULT), out)
