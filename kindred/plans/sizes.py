"""Broadcast only what a count has shown to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a broadcast table, at most, however few its rows.
MOST_BYTES = 64 << 20


def _bytes(df: DataFrame) -> Column:
    """What a row takes, about: 8 bytes a column, and the length of what has no fixed size."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def is_small(df: DataFrame, rows: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes. One aggregate; df should be cheap to compute or stored."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    return n <= rows and (size or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, rows: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small; otherwise unchanged, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, most_bytes) else df
