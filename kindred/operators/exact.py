"""Content hashes, exact duplicate groups, representatives and what is kept or removed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.text import blank
from kindred.plans.numbering import rank_by_hash
from kindred.schema import KEYS, require_columns

ORDER = ("dataset", "subject_id", "session_id", "candidate", "resolved_path")


def content_hash(c) -> F.Column:
    """SHA-256 of a string or binary column as hexadecimal text."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def canonical_text(c) -> F.Column:
    """Text without case and with single spaces: what the canonical hash of a text sees."""
    return F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"\s+", " ")


def hash_items(items: DataFrame, canonicalise: Callable[[bytes], bytes] | None = None, content_col: str = "content") -> DataFrame:
    """resolved_path, can_hash and error of binary contents.

    Without canonicalise the hash stays in the JVM. A canonicaliser (bytes to bytes, for
    instance a decoder of an image format) runs on Arrow batches; what it raises becomes an
    error of that row ("Type: message") and the others go on.
    """
    if canonicalise is None:
        return items.select("resolved_path", F.sha2(content_col, 256).alias("can_hash"), F.lit(None).cast("string").alias("error"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            hashes, errors = [], []
            for data in b.column(1).to_pylist():
                try:
                    hashes.append(hashlib.sha256(canonicalise(data)).hexdigest())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - the row carries it
                    hashes.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], names=["resolved_path", "can_hash", "error"])

    return items.select("resolved_path", content_col).mapInArrow(run, "resolved_path string, can_hash string, error string")


def not_yet_hashed(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose path is not among the hashes of an earlier run."""
    return items.join(done.select("resolved_path").distinct(), "resolved_path", "left_anti")


def excluded_dir(path, names: tuple[str, ...] = ("derivatives",)) -> F.Column:
    """True if any part of the path is one of the names, in any case."""
    parts = F.split(F.lower(F.replace(blank(path), F.lit("\\"), F.lit("/"))), "/")
    return F.exists(parts, lambda x: x.isin(*[n.lower() for n in names]))


def duplicate_groups(hashes: DataFrame, catalog: DataFrame, modality: str, exclude: tuple[str, ...] = ("derivatives",), key: str = "can_hash") -> DataFrame:
    """Rows whose hash occurs more than once: group_id, hash, modality and the catalog's keys.

    group_id is "<key>:<n>" with n counting the repeated hashes in their order. Paths in
    excluded folders are left out first, so every group has two rows at least. Rows that the
    catalog lacks get empty keys. Null and empty hashes form no group.
    """
    require_columns(hashes, ["resolved_path", key])
    rows = hashes.where(F.col(key).isNotNull() & (F.col(key) != "") & ~excluded_dir("resolved_path")).select("resolved_path", F.col(key).alias("_h")) if exclude else hashes.select("resolved_path", F.col(key).alias("_h")).where("_h is not null and _h <> ''")
    repeated = rows.groupBy("_h").agg(F.count("*").alias("_c")).where("_c > 1").select("_h")
    numbered = rank_by_hash(repeated, "_h", "_n")
    joined = rows.join(numbered, "_h").join(catalog.select("resolved_path", *KEYS[:-1]), "resolved_path", "left")
    return joined.select(F.concat(F.lit(f"{key}:"), F.col("_n").cast("string")).alias("group_id"), F.col("_h").alias(key), F.lit(modality).alias("modality"), *[blank(c).alias(c) for c in KEYS[:-1]], "resolved_path")


def representatives(duplicates: DataFrame) -> DataFrame:
    """One row per group: the first by dataset, subject, session, candidate and path."""
    best = F.min(F.struct(*[blank(c).alias(c) for c in ORDER])).alias("r")
    return duplicates.groupBy("group_id").agg(best, F.count("*").alias("n")).select("group_id", "n", "r.*")


def removed_exact(duplicates: DataFrame) -> DataFrame:
    """Members of groups other than their representative, with what is kept instead."""
    kept = representatives(duplicates).select("group_id", F.col("candidate").alias("kept_candidate"), F.col("resolved_path").alias("kept_resolved_path"))
    rows = duplicates.join(kept, "group_id").where("resolved_path <> kept_resolved_path")
    return rows.select(F.lit("EXACT_DUPLICATE").alias("remove_reason"), *KEYS, "kept_candidate", "kept_resolved_path", F.lit("").alias("error"))


def removed_all(duplicates: DataFrame, errors: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact copies and rows whose hash failed; a path that is both counts as a copy."""
    failed = catalog.join(errors.select("resolved_path", "error").dropDuplicates(["resolved_path"]), "resolved_path").select(
        F.lit("HASH_FAILED").alias("remove_reason"), *KEYS, F.lit("").alias("kept_candidate"), F.lit("").alias("kept_resolved_path"), "error"
    )
    both = removed_exact(duplicates).unionByName(failed)
    first = F.row_number().over(Window.partitionBy("resolved_path").orderBy("remove_reason", "kept_resolved_path"))
    return both.withColumn("_r", first).where("_r = 1").drop("_r")


def near_input(catalog: DataFrame, removed: DataFrame, contents: DataFrame) -> DataFrame:
    """Catalog rows that were not removed, with scan_uid: the SHA-256 of the file's bytes.

    contents: resolved_path and raw_hash, and read_at if paths come several times: the last
    read counts. A file keeps its uid where it is moved. Rows whose file was never read have no
    uid and are left out.
    """
    when = F.col("read_at") if "read_at" in contents.columns else F.lit(None).cast("timestamp")
    uid = contents.where("raw_hash is not null").groupBy("resolved_path").agg(F.max_by("raw_hash", F.struct(when.alias("at"), "raw_hash")).alias("scan_uid"))
    return catalog.select(*KEYS).join(removed.select("resolved_path").distinct(), "resolved_path", "left_anti").join(uid, "resolved_path").select(*KEYS, "scan_uid")
