"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables stored by the calls of scratched functions that have not returned yet.
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir of the session.

    Only where that setting is absent (tests, one machine) a folder is chosen here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kindred-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kindred-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    Later jobs reread the files, so a lost executor costs no more than its own tasks,
    and every job sees the same rows. `_stored_path` keeps the place for `drop`; tables
    that are still there when the driver ends are deleted then.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    # what `drop` has not deleted goes when the driver ends
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def scratched(f):
    """A function that returns stored tables; what else it has stored is deleted when it returns.

    Kept are its result, alone or in a tuple, and what the result's `_reads` names.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        _scopes.append([])
        try:
            result = f(*args, **kwargs)
        except BaseException:
            drop(*_scopes.pop())
            raise
        held = _scopes.pop()
        parts = result if isinstance(result, tuple) else (result,)
        kept = {id(t) for part in parts for t in (part, *getattr(part, "_reads", ()))}
        kept_paths = {getattr(t, "_stored_path", None) for t in parts}
        drop(*[t for t in held if id(t) not in kept and t._stored_path not in kept_paths])
        if _scopes:
            _scopes[-1] += [t for t in held if id(t) in kept or t._stored_path in kept_paths]
        return result

    return run


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and that nothing reads any more; twice does no harm."""
    for t in tables:
        path = getattr(t, "_stored_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
