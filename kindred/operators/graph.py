"""Connected components over an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.stored import drop, stored

#: Rounds before giving up; the number needed grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) for every node of an undirected edge table.

    Alternates large-star and small-star steps until the edges form stars around the
    smallest node of each component. Every step is a group-by with map-side combining and a
    join that adaptive execution may split, so one node with very many edges is no bottleneck.
    Each round is written to the shared folder.

    Self-loops make a component of one node; edges with a null end are ignored; repeated and
    reversed edges count once. An empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    held = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    first, before = held, None
    for _ in range(MAX_ROUNDS):
        mark = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == before or mark.n == 0:
            break
        before = (mark.n, mark.h)
        # large star: every node hands its smallest neighbour to its larger neighbours
        near = held.select("a", "b").union(held.select("b", "a")).toDF("u", "v").groupBy("u").agg(F.min("v").alias("m"))
        near = near.select("u", F.least("u", "m").alias("m"))
        large = held.join(near, held.b == near.u).select("a", F.col("m").alias("b")).distinct()
        # small star: every node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        if held is not first:
            drop(held)
        held = step
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).union(loops)
    return found.groupBy("node").agg(F.min("component").alias("component"))
