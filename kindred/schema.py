"""Column sets of the audit tables and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


KEYS = ("dataset", "subject_id", "session_id", "candidate", "resolved_path")
CANDIDATES = strings("dataset", "subject_id", "session_id", "candidate")
VALID = strings(*KEYS)
HASHES = strings("resolved_path", "can_hash")
HASH_ERRORS = strings("resolved_path", "error")
DUPLICATES = strings("group_id", "can_hash", "modality", *KEYS)
REMOVED = strings("remove_reason", *KEYS, "kept_candidate", "kept_resolved_path", "error")
NEAR_INPUT = strings(*KEYS, "scan_uid")
MANIFEST = T.StructType([*NEAR_INPUT.fields, T.StructField("emb_row", T.LongType())])
FAILURES = strings(*KEYS, "scan_uid", "stage", "error")
NEIGHBOURS = T.StructType([*strings(*(f"{s}_{c}" for s in ("query", "cand") for c in (*KEYS, "scan_uid"))).fields, T.StructField("rank", T.LongType()), T.StructField("similarity", T.DoubleType())])
PAIRS = T.StructType(
    [*strings(*(f"{c}_{s}" for s in ("a", "b") for c in (*KEYS, "scan_uid"))).fields, T.StructField("similarity", T.DoubleType()), T.StructField("best_rank", T.LongType()), T.StructField("n_directions", T.LongType())]
)
DECISIONS = strings(*(f"{c}_{s}" for s in (1, 2) for c in ("dataset", "subject_id", "session_id", "path")), "qa_status", "reason", "date")
EDGES = T.StructType([*strings(*(f"{c}_{s}" for s in ("a", "b") for c in ("dataset", "subject_id", "subject_key"))).fields, T.StructField("n_yes_scan_pairs", T.LongType())])
GROUPS = T.StructType([T.StructField("group_id", T.StringType()), T.StructField("group_size", T.LongType()), *strings("dataset", "subject_id", "subject_key").fields])


def require_columns(df: DataFrame, columns) -> DataFrame:
    """df, or ValueError naming the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or ValueError if a key occurs twice. Runs one aggregate."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} is not unique: {twice[0]}")
    return df


def require_dense(df: DataFrame, column: str = "emb_row") -> DataFrame:
    """df, or ValueError unless column is exactly 0..n-1. Runs one aggregate."""
    r = df.agg(F.count("*").alias("n"), F.count_distinct(column).alias("d"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if r.n and (r.d != r.n or r.lo != 0 or r.hi != r.n - 1):
        raise ValueError(f"{column} is not 0..{r.n - 1}")
    return df


def require_length(df: DataFrame, column: str = "embedding") -> DataFrame:
    """df, or ValueError unless all arrays in column have one length. Runs one aggregate."""
    r = df.agg(F.min(F.coalesce(F.size(column), F.lit(-1))).alias("lo"), F.max(F.coalesce(F.size(column), F.lit(-1))).alias("hi")).first()
    if r.lo != r.hi or r.lo == -1:
        raise ValueError(f"{column} has lengths from {r.lo} to {r.hi}")
    return df
