"""Matrices in NumPy's .npy format, as a data source: rows are (emb_row, embedding).

Reading: the header is read once, then every task opens the file and reads its own range of rows.
Paths and URIs go through pyarrow's file systems (local and mounted files, HDFS, object stores).

Writing needs a file system that can write at any place (local or mounted). The driver makes a
hidden file of the final size; each task writes its rows to their places in it. A task that runs
twice writes the same bytes to the same places, so lost executors leave nothing to mend. When all
rows are there, one rename makes the matrix appear; a job that fails leaves what was there before.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of the matrix that a task reads, about, and of one batch of rows.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _opened(path: str) -> pa.NativeFile:
    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        system, at = fs.LocalFileSystem(), path
    return system.open_input_file(at)


def local_path(path: str) -> str:
    """The path of a local or mounted file; ValueError for other places."""
    if "://" not in path and not path.startswith("file:"):
        return path
    parts = urlparse(path)
    if parts.scheme != "file":
        raise ValueError(f"{path}: a matrix can be written to a local or mounted file alone")
    return unquote(parts.path)


@dataclass(frozen=True)
class Header:
    """Shape and type of a matrix, and where its rows begin."""

    rows: int
    width: int
    dtype: str
    start: int

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize


def read_header(path: str) -> Header:
    """ValueError if the file isn't a whole matrix of numbers, row by row."""
    with _opened(path) as f:
        version = np.lib.format.read_magic(f)
        if version not in ((1, 0), (2, 0)):
            raise ValueError(f"{path}: unknown version {version}")
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        if len(shape) != 2 or (fortran and min(shape) > 1) or dtype.kind not in "fiu":
            raise ValueError(f"{path}: shape {shape}, type {dtype}{', by columns' if fortran else ''}; a matrix of numbers, row by row, is needed")
        out = Header(shape[0], shape[1], dtype.str, f.tell())
        if f.size() < out.start + out.rows * out.row_bytes:
            raise ValueError(f"{path} ends before its last row")
    return out


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.header = read_header(self.path)

    def partitions(self) -> list[Rows]:
        step = max(1, self.task_bytes // max(1, self.header.row_bytes))
        return [Rows(lo, min(lo + step, self.header.rows)) for lo in range(0, self.header.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h = self.header
        step = max(1, BATCH_BYTES // max(1, h.row_bytes))
        with _opened(self.path) as f:
            f.seek(h.start + partition.first * h.row_bytes)
            for lo in range(partition.first, partition.last, step):
                n = min(step, partition.last - lo)
                raw = f.read(n * h.row_bytes)
                if len(raw) != n * h.row_bytes:
                    raise ValueError(f"{self.path} ends before its last row")
                values = np.frombuffer(raw, h.dtype).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), lists], names=["emb_row", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    rows: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.hidden = options["path"], options["hidden"]
        self.rows, self.width, self.start = int(options["rows"]), int(options["width"]), int(options["start"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n, row_bytes = 0, 4 * self.width
        with open(self.hidden, "r+b") as f:
            for b in iterator:
                at, lists = b.column(0).to_numpy(), b.column(1)
                if lists.null_count or (np.diff(lists.offsets.to_numpy()) != self.width).any():
                    raise ValueError(f"a row is null or not of {self.width} numbers")
                if len(at) and not (0 <= at.min() and at.max() < self.rows):
                    raise ValueError("a row has no place in the matrix")
                values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(at), self.width)
                order = np.argsort(at, kind="stable")
                runs = np.split(order, np.flatnonzero(np.diff(at[order]) != 1) + 1) if len(order) else []
                for run in runs:
                    f.seek(self.start + int(at[run[0]]) * row_bytes)
                    f.write(values[run].tobytes())
                n += len(at)
            f.flush()
            os.fsync(f.fileno())
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        found = sum(m.rows for m in messages if m is not None)
        if found != self.rows:
            self.abort(messages)
            raise ValueError(f"{found} of {self.rows} rows came")
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.unlink(self.hidden)


class NpyDataSource(DataSource):
    """Format `npy`. Option taskBytes: what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "emb_row long, embedding array<float>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options)


def read_npy(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """emb_row and embedding of each row of a matrix; any type of numbers comes as float."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("taskBytes", str(task_bytes)).load(path)


def write_npy(rows: DataFrame, path: str, rows_col: str = "emb_row", values_col: str = "embedding") -> str:
    """Writes a matrix of float32. rows: numbers 0..n-1, each once, and arrays of one length, not null.

    Without rows the matrix has no columns either. ValueError (and no file) for anything else.
    """
    spark, at = rows.sparkSession, local_path(path)
    held = rows.select(F.col(rows_col).cast("long").alias("emb_row"), F.col(values_col).cast("array<float>").alias("embedding"))
    told = held.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding")), F.min("emb_row"), F.max("emb_row"), F.count_distinct("emb_row"), F.count("embedding")).first()
    n, least, width = told[0], told[1] or 0, told[2] or 0
    if n and (least != width or told[6] != n or (told[3], told[4], told[5]) != (0, n - 1, n)):
        raise ValueError(f"{n} rows, numbers from {told[3]} to {told[4]}, {told[5]} of them different, {told[6]} arrays of {least} to {width} numbers")
    hidden = f"{os.path.dirname(at) or '.'}/.{os.path.basename(at)}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(hidden), exist_ok=True)
    with open(hidden, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n, width)})
        start = f.tell()
        f.truncate(start + 4 * n * width)
    spark.dataSource.register(NpyDataSource)
    try:
        held.write.format("npy").mode("append").options(hidden=hidden, rows=n, width=width, start=start).save(at)
    finally:
        if os.path.exists(hidden):
            os.unlink(hidden)
    return path
