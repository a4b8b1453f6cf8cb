"""Shards of equal row counts that keep linked documents together.

propagate_labels: every linked document starts in a shard of its own hash and moves, round by
round, to the shard where most of its neighbours are. In even rounds only neighbours with
smaller ids count, so that no two documents swap their places forever; in odd rounds all do,
and half of the documents may move. Moves are limited by capacity: from the number of
documents that want to go from each shard to each other one, a table of shards x shards
counts, the driver finds the share of each that may go, so that no shard exceeds its quota
once the documents that leave have left; a hash of id and round decides who goes. After the
last round, those that still want to go to a full shard go to the emptiest ones together.

balanced_shards links equal texts as stars: rows of a group hang on the smallest id of their
part of the group (of half a shard at most); parts of one group start in neighbouring shards.
Documents without links fill the shards. What makes the shards exactly even is the layout:
documents are numbered in the order of shards, those without links first and last in each, and
equal runs of numbers become the final shards, so that the cuts fall between groups as long as
there are documents without links.

Numbering needs no global sort. Rows fall into a bounded number of blocks (groups above the
mean block size are dealt over blocks of their own); block counts are summed up on a table of
at most BLOCKS * (shards + 4) rows, and row numbers are taken within each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import drop, scratched, stored

#: Blocks of the layout.
BLOCKS = 2560
#: What a shard may hold above its even part while documents still move.
SLACK = 0.05
ROUNDS = 8
#: Rows of groups or labels (some 30 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Round:
    """What a round did: links between shards before it, documents that wanted to move and that did."""

    cut_edges: int
    asked: int
    moved: int


def admitted(asked: np.ndarray, load: np.ndarray, quota: float) -> np.ndarray:
    """The share of the documents asking to go from shard i to shard j that may go.

    Shares are cut until no shard's load, after all moves, exceeds its quota; a shard above
    its quota admits as many as leave it at most.
    """
    share = np.ones_like(asked)
    for _ in range(200):
        flow = asked * share
        room = np.maximum(quota, load) - load + flow.sum(1)
        comes = flow.sum(0)
        over = comes > room + 1e-9
        if not over.any():
            break
        share[:, over] *= (room[over] / comes[over])[None, :]
    return share


def overflow(left: np.ndarray, load: np.ndarray, quota: float) -> list[tuple[int, int, float, float]]:
    """Where documents go that found no room: (goal, target, from, to) with shares of those that
    left[goal] counts. The emptiest shards are filled first, the largest numbers placed first."""
    room, out = quota - load, []
    for goal in np.argsort(-left, kind="stable"):
        done = 0.0
        while left[goal] > 0 and done < left[goal]:
            target = int(room.argmax())
            n = min(left[goal] - done, room[target])
            if n < 1:
                break
            out.append((int(goal), target, done / left[goal], (done + n) / left[goal]))
            room[target] -= n
            done += n
    return out


def propagate_labels(links: DataFrame, shards: int, even: float, seeds: DataFrame | None = None, rounds: int = ROUNDS, slack: float = SLACK) -> tuple[DataFrame, list[Round]]:
    """id and label of every end of a link (a, b), and what each round did.

    even: documents of a shard if all are equal. seeds: id and label where some of them start.
    Links count once in either direction; self-links and links with a null end are ignored.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    start = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    state = pairs.select(F.col("a").alias("id")).distinct()
    if seeds is not None:
        given = broadcast_if_small(seeds.select(F.col("id").alias("of"), F.col("label").cast("int").alias("given")), BROADCAST_ROWS)
        state = state.join(given, state.id == F.col("of"), "left").withColumn("label", F.coalesce("given", start))
    else:
        state = state.withColumn("label", start)
    state = stored(state.select("id", "label"), "labels")
    draw = lambda r: F.pmod(F.xxhash64("id", F.lit(r), F.lit("goes")), F.lit(1 << 20)) / float(1 << 20)
    done: list[Round] = []
    for r in range(2 * ((rounds + 1) // 2) + 1 if rounds else 0):
        last = r >= rounds
        near = pairs.join(state.withColumnRenamed("label", "there"), pairs.b == state.id).groupBy("a", "there")
        near = near.agg(F.count("*").alias("n"), F.count(F.when((F.col("b") < F.col("a")) | F.lit(r % 2 == 1), 1)).alias("votes"))
        tops = near.groupBy("a").agg(F.sum("n").alias("links"), F.max(F.struct("votes", (-F.col("there")).alias("k"))).alias("top"), F.map_from_entries(F.collect_list(F.struct("there", F.struct("n", "votes")))).alias("by"))
        here = F.col("by")[F.col("label")]
        wish = state.join(tops, state.id == tops.a).select("id", "label", "links", F.coalesce(here["n"], F.lit(0)).alias("inside"), (-F.col("top.k")).alias("goal"), (F.col("top.votes") > F.coalesce(here["votes"], F.lit(0))).alias("better"))
        may = F.lit(True) if r % 2 == 0 else F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        wish = stored(wish.select("id", "label", F.when(F.col("better") & may, F.col("goal")).otherwise(F.col("label")).cast("int").alias("goal"), "links", "inside"), "wishes")
        flows = wish.groupBy("label", "goal").agg(F.count("*").alias("n"), F.sum(F.col("links") - F.col("inside")).alias("cut")).collect()  # shards * shards rows at most
        asked, load = np.zeros((shards, shards)), np.zeros(shards)
        for f in flows:
            load[f.label] += f.n
            if f.label != f.goal:
                asked[f.label, f.goal] = f.n
        share = admitted(asked, load, even * (1 + slack))
        rows = [(int(i), int(j), float(share[i, j])) for i, j in np.argwhere(asked > 0)]
        cut = sum(f.cut for f in flows) // 2
        if not rows:
            done.append(Round(cut, 0, 0))
            drop(wish)
            if r % 2 == 0 and not last:
                continue
            break
        allowed = F.broadcast(links.sparkSession.createDataFrame(rows, "label int, goal int, share double"))
        moves = (F.col("label") != F.col("goal")) & (draw(r) < F.coalesce("share", F.lit(0.0)))
        step = wish.join(allowed, ["label", "goal"], "left").withColumn("to", F.when(moves, F.col("goal")).otherwise(F.col("label")))
        if last:
            flow = asked * share
            placed = overflow(np.floor((asked - flow).sum(0)), load + flow.sum(0) - asked.sum(1), even * (1 + slack))
            other = F.col("to")
            for goal, target, begin, end in placed:  # shards * 2 entries at most
                other = F.when((F.col("goal") == goal) & (F.col("at") >= begin) & (F.col("at") < end), F.lit(target)).otherwise(other)
            step = step.withColumn("at", draw(r + 1)).withColumn("to", F.when((F.col("label") != F.col("goal")) & (F.col("to") == F.col("label")), other).otherwise(F.col("to")))
        step = stored(step.select("id", F.col("to").cast("int").alias("label"), (F.col("to") != F.col("label")).alias("moved")), "labels")
        done.append(Round(cut, int(asked.sum()), step.where("moved").count()))
        drop(state, wish)
        state = step
    drop(pairs)
    out = state.select("id", "label")
    out._stored_path = state._stored_path
    return out, done


def copy_links(rows: DataFrame, groups: DataFrame, part_rows: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of rows (id, grp) of equal groups, and seeds (id, label) of the stars' centres.

    groups: grp, n. Each row hangs on the smallest id of its part of the group, of about
    part_rows rows. Two parts of a group start in one shard, the next two in the next one.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / part_rows)).cast("int")
    of = rows.where("id is not null").join(broadcast_if_small(groups, BROADCAST_ROWS), "grp").select("id", "grp", F.pmod(F.xxhash64("id", F.lit(1)), parts).alias("part"))
    heads = stored(of.groupBy("grp", "part").agg(F.min("id").alias("head")), "heads")
    links = stored(of.join(broadcast_if_small(heads, BROADCAST_ROWS), ["grp", "part"]).select(F.col("id").alias("a"), F.col("head").alias("b")).where("a <> b"), "links")
    seeds = heads.groupBy(F.col("head").alias("id")).agg(F.min(F.pmod(F.xxhash64("grp") + F.floor(F.col("part") / 2), F.lit(shards))).alias("label"))
    seeds = stored(seeds, "seeds")
    drop(heads)
    return links, seeds


@scratched
def balanced_shards(documents: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Documents with equal texts are linked. Row counts of any two shards differ by one at most.
    size: UTF-8 bytes of the text plus 16; a null text has no bytes and the checksum of an
    empty one. Rows without id, and repeated rows, are placed like any others. An empty table
    gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(
        documents.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("grp")
        ),
        "rows",
    )
    total = rows.count()
    even = total / shards
    groups = stored(rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    links, seeds = copy_links(rows, groups, max(1, int(even / 2)), shards)
    labels, _ = propagate_labels(links, shards, even, seeds)
    target = max(1, -(-total // BLOCKS))
    large = groups.where(F.col("n") > target).select("grp", F.ceil(F.col("n") / target).cast("int").alias("parts"))
    # each of at most BLOCKS large groups has blocks of its own, 2 * BLOCKS in all at most, in each shard
    linked = rows.join(broadcast_if_small(labels, BROADCAST_ROWS), "id", "left").join(F.broadcast(large), "grp", "left")
    own = F.when(F.col("label").isNotNull() & F.col("parts").isNotNull(), F.col("grp"))
    linked = stored(linked.select("id", "size", "text_crc32", "grp", "label", own.alias("own"), "parts"), "linked")
    load = np.zeros(shards)
    for r in linked.where("label is not null").groupBy("label").count().collect():
        load[r.label] = r["count"]
    # rows without links take what room there is, rows of one text the same
    room = np.maximum(even - load, 0)
    ends = (np.cumsum(room) / room.sum()).tolist()[:-1] if room.sum() > 0 else [(k + 1) / shards for k in range(shards - 1)]
    at = F.pmod(F.xxhash64("grp"), F.lit(1 << 30)) / float(1 << 30)
    fills = sum((F.when(at >= e, 1).otherwise(0) for e in ends), F.lit(0))
    within = F.pmod(F.xxhash64("grp", F.lit(3)), F.lit(max(2, BLOCKS // shards)))
    zone = F.when(F.col("label").isNotNull(), 1).when(within % 2 == 0, 0).otherwise(2)
    placed = linked.select(
        "id", "size", "text_crc32", "grp", F.coalesce("label", fills).alias("label"), zone.alias("zone"), "own",
        F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(within).cast("int").alias("part"),
    )
    placed = stored(placed, "placed")
    block = ["label", "zone", "own", "part"]
    counts = placed.groupBy(*block).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"{c}_") for c in block), before.alias("start"))
    joined = placed.join(F.broadcast(starts), (placed.label == starts.label_) & (placed.zone == starts.zone_) & placed.own.eqNullSafe(starts.own_) & (placed.part == starts.part_))
    rank = F.col("start") + F.row_number().over(Window.partitionBy(*block).orderBy("grp", "id")) - 1
    out = joined.withColumn("rank", rank).withColumn("shard", F.expr(f"cast(rank * {shards} div {max(1, total)} as int)"))
    # the first rank of a shard is the smallest r with r * shards div total = shard
    slot = F.expr(f"rank - (shard * {total} + {shards - 1}) div {shards}")
    return stored(out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot.cast("long").alias("slot")), "shards")
