"""Tables that outlive a lost executor, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: the shuffles of a query are deleted when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL_MODE_DIR: list[str] = []
_WRITTEN: dict[str, list[str]] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where the setting is absent (local tests) a temporary one, deleted at the end."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_MODE_DIR:
        _LOCAL_MODE_DIR.append(tempfile.mkdtemp(prefix="veilstone-"))
        atexit.register(shutil.rmtree, _LOCAL_MODE_DIR[0], ignore_errors=True)
    return "file://" + _LOCAL_MODE_DIR[0]


def working_folder(spark: SparkSession, scope: str = "query") -> str:
    """A new folder in the shared one, deleted by release() or when the driver's process ends."""
    path = f"{shared_dir(spark)}/veilstone/{scope}-{uuid.uuid4().hex}"
    with _LOCK:
        _WRITTEN.setdefault(scope, []).append(path)
    at, system = _place(spark, path)
    system.mkdirs(at)  # what does not exist is not marked
    system.deleteOnExit(at)
    return path


def keep(df: DataFrame, scope: str = "query", batch_rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the lineage ends in a replayable table, and Spark deletes
    the shuffles that led to it as soon as it is written. Tables that nobody released go when the driver's process ends,
    whether the session was stopped before or not. `batch_rows`: rows to an Arrow batch, for functions on rows that are large.
    """
    spark = df.sparkSession
    path = working_folder(spark, scope)
    _apart(df, batch_rows).write.parquet(f"{path}/table")
    kept = spark.read.schema(df.schema).parquet(f"{path}/table")
    kept._kept_at = path
    return kept


def _apart(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """The same plan in a session of its own, in which the switch is on: what else runs in the caller's session has its own."""
    spark = df.sparkSession
    session = spark._jsparkSession.cloneSession()
    session.conf().set(_CLEANUP, "true")
    if batch_rows:
        session.conf().set(_BATCH_ROWS, str(batch_rows))
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), SparkSession(spark.sparkContext, session))


def release(spark: SparkSession, scope: str) -> None:
    """Delete the tables kept under `scope`; call it only once every result that reads them is written."""
    with _LOCK:
        paths = _WRITTEN.pop(scope, [])
    for path in paths:
        delete(spark, path)


def discard(table: DataFrame) -> None:
    """Delete a table made by keep() that nothing reads any more."""
    path, spark = table._kept_at, table.sparkSession
    with _LOCK:
        for paths in _WRITTEN.values():
            if path in paths:
                paths.remove(path)
    delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at, system = _place(spark, path)
    system.delete(at, True)
    system.cancelDeleteOnExit(at)


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())
