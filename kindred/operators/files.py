"""Facts about files: one read of each gives size, times, hashes and what a decoder finds."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes read at a time where only the raw hash is wanted.
CHUNK_BYTES = 4 << 20
#: Files beyond that are decoded in pieces, if the decoder can (its attribute in_pieces, from a path to facts).
LARGE_BYTES = 32 << 20
#: Facts that a decoder gives, with their types; a decoder may leave some out.
DECODED = {
    "can_hash": "string", "value_hash": "string", "shape": "array<int>", "dtype": "string", "zooms": "array<double>", "axcodes_original": "string", "axcodes_canonical": "string", "slope": "double", "inter": "double",
    "qform_code": "int", "sform_code": "int", "qform": "array<double>", "sform": "array<double>", "header_hash": "string", "extensions": "string",
}
RAW = {"resolved_path": "string", "n_bytes": "long", "mtime": "string", "ctime": "string", "raw_hash": "string", "raw_error": "string", "error": "string"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _moment(t: float) -> str:
    return datetime.fromtimestamp(t, timezone.utc).isoformat(sep=" ", timespec="seconds")[:19]


def read_facts(path: str, inspect: Callable[[bytes], dict] | None = None) -> dict:
    """The facts of one file; what fails becomes raw_error (MISSING, PERMISSION, ERROR:Type) and error.

    Without a decoder the canonical hash is the raw one and the file is read in chunks.
    """
    out: dict = {"resolved_path": path}
    try:
        stat = os.stat(path)
        out |= {"n_bytes": stat.st_size, "mtime": _moment(stat.st_mtime), "ctime": _moment(stat.st_ctime)}
        with open(path, "rb") as f:
            pieces = getattr(inspect, "in_pieces", None) if stat.st_size > LARGE_BYTES else None
            if inspect is None or pieces:
                digest = hashlib.sha256()
                while chunk := f.read(CHUNK_BYTES):
                    digest.update(chunk)
                out["raw_hash"] = digest.hexdigest()
                if inspect is None:
                    return out | {"can_hash": out["raw_hash"]}
            else:
                data = f.read()
    except OSError as e:
        reason = "MISSING" if isinstance(e, FileNotFoundError) else "PERMISSION" if isinstance(e, PermissionError) else f"ERROR:{type(e).__name__}"
        return out | {"raw_error": reason, "error": f"{type(e).__name__}: {e}"}
    try:
        if pieces:
            return out | pieces(path)
        out["raw_hash"] = hashlib.sha256(data).hexdigest()
        return out | inspect(data)
    except Exception as e:  # noqa: BLE001 - the row carries it
        return out | {"error": f"{type(e).__name__}: {e}"}


def file_facts(paths: DataFrame, inspect: Callable[[bytes], dict] | None = None) -> DataFrame:
    """RAW and DECODED facts of each path in the column resolved_path. Every file is read once.

    inspect: from a file's bytes to DECODED facts, for instance nifti.inspect.
    """
    types = RAW | DECODED

    def run(batches):
        for b in batches:
            rows = [read_facts(p, inspect) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW[t]) for c, t in types.items()], names=list(types))

    return paths.select("resolved_path").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()))
