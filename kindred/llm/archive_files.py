"""WARC archives as files (.warc.gz) that other programs open, and such files as archives.

Files are written by the tasks that hold the archives, through pyarrow's file systems (local and
mounted files, HDFS, object stores), and read through Spark's own reader of binary files.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import map_batches


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs.LocalFileSystem(), folder


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """path and bytes of the files written, one for each value of the column archive. An action writes them.

    A file is named after its content and appears by a rename, so a task that runs twice leaves
    one file, and one that is lost leaves none under that name. Equal archives share a file; null
    and empty ones have none.
    """

    def write(b: pa.RecordBatch) -> pa.RecordBatch:
        system, at = _place(folder)
        system.create_dir(at, recursive=True)
        paths, sizes = [], []
        for data in b.column(0).to_pylist():
            if data:
                name = f"{at.rstrip('/')}/{hashlib.sha256(data).hexdigest()[:32]}.warc.gz"
                if system.get_file_info(name).size != len(data):
                    hidden = f"{at.rstrip('/')}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(hidden, compression=None) as out:
                        out.write(data)
                    system.move(hidden, name)
                paths.append(name)
                sizes.append(len(data))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return map_batches(archives.select("archive"), write, "path string, bytes long")


def open_archives(spark: SparkSession, folder: str) -> DataFrame:
    """`archive binary` of the .warc.gz files in a folder; each is held whole by a task, as archives.convert_archives made them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("content").alias("archive"))
