"""Embedding with a pluggable encoder: resumable, failures as rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.plans.numbering import row_numbers
from kindred.schema import KEYS

#: Where an item can fail, in the order of the work.
STAGES = ("preprocessing", "preprocessed_tensor_load", "inference", "embedding_persist")


def encode(items: DataFrame, preprocess: Callable, encoder: Callable, batch_size: int = 32, normalise: bool = True, load: Callable | None = None, length: int | None = None, fail_fast: bool = False) -> DataFrame:
    """scan_uid, embedding, stage and error of every item.

    items: scan_uid, resolved_path. preprocess(path) gives a tensor, or with load what
    load(...) makes a tensor of (for instance the path of a cached file); encoder(list of
    tensors) a list of vectors. What fails becomes a row with stage and error: if a batch
    fails in the encoder its items are tried one by one, and a vector that is not finite or
    not of the given length can't be kept. fail_fast: the first failure ends the job.
    """

    def run(batches):
        import numpy as np

        def failed(uid, stage, e):
            if fail_fast:
                raise RuntimeError(f"{stage} of {uid} failed: {type(e).__name__}: {e}") from e
            return uid, None, stage, f"{type(e).__name__}: {e}"

        def kept(uid, v):
            try:
                v = np.asarray(v, np.float32)
                if v.ndim != 1 or (length is not None and len(v) != length):
                    raise ValueError(f"shape {v.shape}")
                if not np.isfinite(v).all():
                    raise ValueError("not finite")
            except Exception as e:  # noqa: BLE001 - the row carries it
                return failed(uid, "embedding_persist", e)
            n = float(np.linalg.norm(v))
            return uid, (v / n if normalise and n > 1e-12 else v).tolist(), None, None

        def rows(part):
            ready, out = [], []
            for uid, path in part:
                stage = "preprocessing"
                try:
                    tensor = preprocess(path)
                    if load is not None:
                        stage = "preprocessed_tensor_load"
                        tensor = load(tensor)
                    ready.append((uid, tensor))
                except Exception as e:  # noqa: BLE001 - the row carries it
                    out.append(failed(uid, stage, e))
            try:
                vectors = list(encoder([t for _, t in ready])) if ready else []
                done = [(uid, v) for (uid, _), v in zip(ready, vectors, strict=True)]
            except Exception:  # noqa: BLE001 - one by one
                done = []
                for uid, t in ready:
                    try:
                        done.append((uid, encoder([t])[0]))
                    except Exception as e:  # noqa: BLE001
                        out.append(failed(uid, "inference", e))
            return [kept(uid, v) for uid, v in done] + out

        for b in batches:
            items_ = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for lo in range(0, len(items_), batch_size):
                got = list(zip(*rows(items_[lo : lo + batch_size]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array(got[1], pa.list_(pa.float32())), pa.array(got[2], pa.string()), pa.array(got[3], pa.string())], names=["scan_uid", "embedding", "stage", "error"])

    return items.select("scan_uid", "resolved_path").mapInArrow(run, "scan_uid string, embedding array<float>, stage string, error string")


def sound(parts: DataFrame, length: int | None = None) -> DataFrame:
    """One row per scan of an embedding store that earlier runs wrote, without rows that are of no use.

    Rows without a vector, with another length (by default the most frequent one) or with
    values that aren't finite go, so their scans are pending again.
    """
    rows = parts.where("scan_uid is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    if length is None:
        top = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = top.n if top else 0
    return rows.where(F.size("embedding") == length).select("scan_uid", "embedding").dropDuplicates(["scan_uid"])


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without an embedding so far."""
    return items.join(done.select("scan_uid").distinct(), "scan_uid", "left_anti")


def manifest(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items that have an embedding, numbered 0..n-1 by scan_uid, with it as a column."""
    rows = items.select(*KEYS, "scan_uid").dropDuplicates(["scan_uid"]).join(done.where("embedding is not null").select("scan_uid", "embedding").dropDuplicates(["scan_uid"]), "scan_uid")
    return row_numbers(rows, ["scan_uid"], "emb_row").withColumn("emb_row", F.col("emb_row") - 1)


def merge_failures(old: DataFrame, new: DataFrame, successes: DataFrame) -> DataFrame:
    """The newest failure of each scan that hasn't succeeded since. old, new: scan_uid, stage, error."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("scan_uid").orderBy(F.desc("_v"), "stage", "error"))
    return both.join(successes.select("scan_uid").distinct(), "scan_uid", "left_anti").withColumn("_r", first).where("_r = 1").drop("_r", "_v")
