"""Row-wise Python over Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of one Arrow batch: what a Python worker holds of the input at a time.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batch bounds, so that very long texts don't add up in a worker.

    Bounds belong to a session, not to one operator: smaller ones that were set stay.
    """
    conf, unit = df.sparkSession.conf, df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not 0 < unit.byteStringAsBytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def _give_back() -> None:
    """Returns freed memory to the system: an idle worker otherwise keeps its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema, done: Callable[[], None] = lambda: None) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped.

    done is called at the end of each task: workers outlive their tasks, so what they
    remember is given back there.
    """

    def run(batches):
        try:
            for b in batches:
                if b.num_rows:
                    out = f(b)
                    if isinstance(out, pa.RecordBatch):
                        yield out
                    else:
                        yield from out
        finally:
            done()
            _give_back()

    return bounded_batches(df).mapInArrow(run, schema)
