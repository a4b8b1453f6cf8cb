"""Incremental forms: hashing new files once, and decisions that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import decisions


def first_seen(stream: DataFrame, key: str, time_col: str, delay: str) -> DataFrame:
    """Rows of a stream whose key hasn't come within the delay: exact dedup with bounded state."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def duplicate_counts(stream: DataFrame, key: str, time_col: str, window: str, delay: str) -> DataFrame:
    """Rows of each key and time window of a stream."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n"))


def apply_decisions(batch: DataFrame, epoch: int, table: str) -> None:
    """foreachBatch writer of a decision log: one folder per epoch, so a replayed epoch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")


def current_decisions(log: DataFrame) -> DataFrame:
    """The state of a log that apply_decisions wrote."""
    return decisions.latest(log.drop("epoch"))
