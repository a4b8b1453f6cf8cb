"""Writers: Parquet through Spark's commit protocol, single CSV files for people."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    """Parquet; a failed job leaves no partial table."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def append_table(df: DataFrame, path: str) -> str:
    """Adds rows to a checkpoint table."""
    return write_table(df, path, mode="append")


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> str:
    """One CSV file with header at `path`, also without rows; it appears by one rename.

    For reports that people read: the rows go through one task.
    """
    spark = df.sparkSession
    tmp = f"{path}.writing"
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(tmp)
    jvm = spark._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{tmp}/part-*"))]
    fs.delete(to, False)
    if parts:
        fs.rename(parts[0], to)
    else:
        out = fs.create(to)
        out.write((",".join(df.columns) + "\n").encode())
        out.close()
    fs.delete(at, True)
    return path


def write_csv_parts(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> str:
    """A folder of CSV files with header, written by all tasks; in the order of their names if order is given.

    The readers take it like one file; without rows there is a file with the header.
    """
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def write_by_dataset(df: DataFrame, path: str) -> str:
    """One folder per dataset; rows are gathered by dataset and split where it is large."""
    return write_table(df.hint("rebalance", "dataset"), path, ("dataset",))


def write_by_status(df: DataFrame, path: str) -> str:
    return write_table(df, path, ("status",))


def copy_config(config_path: str, out_dir: str) -> str:
    """A copy of the configuration next to the results."""
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    return shutil.copy2(config_path, Path(out_dir) / "config_used.toml")
