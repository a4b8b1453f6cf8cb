"""Consecutive numbers over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.plans.stored import drop, stored

#: Up to so many rows are numbered by a plain window.
SMALL_ROWS = 100_000


def rank_by_hash(keys: DataFrame, key: str, out: str) -> DataFrame:
    """Numbers 1..n in the order of a hexadecimal key that is unique in keys.

    Numbers are taken within the 4096 prefixes of three digits, whose counts (one small
    table) are summed up; so the result is that of a global row number.
    """
    prefixed = keys.withColumn("_p", F.substring(key, 1, 3))
    counts = prefixed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_s")))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return prefixed.join(starts, "_p").withColumn(out, (F.col("_s") + inner).cast("long")).drop("_p", "_s")


def row_numbers(df: DataFrame, order: list, out: str) -> DataFrame:
    """Numbers 1..n in a total order. df is computed once; large tables are range partitioned."""
    held = stored(df, "rows")
    if held.count() <= SMALL_ROWS:
        return held.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    parts = stored(held.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    drop(held)
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_s")))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(starts, "_p").withColumn(out, (F.col("_s") + inner).cast("long")).drop("_p", "_s")


def group_numbers(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Numbers 1..n within each group in an order of plain columns.

    Groups of up to SMALL_ROWS rows are sorted by a task; larger ones are range partitioned, and
    the counts of a group's ranges (one small table) are summed up.
    """
    held = stored(df, "groups")
    numbered = lambda rows: rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    large = held.groupBy(*group).agg(F.count("*").alias("_c")).where(F.col("_c") > SMALL_ROWS).drop("_c")
    large = stored(large, "large")
    if large.isEmpty():
        drop(large)
        return numbered(held)
    same = F.lit(True)
    mark = large.select(*[F.col(c).alias(f"_g_{c}") for c in group])
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    small = numbered(held.join(F.broadcast(mark), same, "left_anti"))  # at most n / SMALL_ROWS groups
    rows = held.join(F.broadcast(mark), same, "left_semi").repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id())
    rows = stored(rows, "numbered")
    counts = rows.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_p").alias("_q"), before.alias("_s"))
    inner = F.row_number().over(Window.partitionBy("_p", *group).orderBy(*order))
    found = rows.join(F.broadcast(starts), same & (F.col("_p") == F.col("_q"))).withColumn(out, (F.col("_s") + inner).cast("long"))
    return small.unionByName(found.select(*small.columns))
