"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: Where the tables are that ``cut`` wrote.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session; a folder of our own is taken only where it is
    unset and all runs in one process (``local``, as in tests): on a cluster that is an error.
    The folder is removed when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or tempfile.mkdtemp(prefix="tessera-")
        _FOLDERS[app] = f"{base}/tessera-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: lineage ends there,
    and a lost executor costs no more than the tasks that read the table. The shuffle files of
    the write go with its end, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


_LOCK, _DEPTH, _BEFORE = threading.Lock(), [0], [""]


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Sets the clean-up while any thread writes; the last of them sets back what was there."""
    with _LOCK:
        if not _DEPTH[0]:
            _BEFORE[0] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _DEPTH[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _DEPTH[0] -= 1
            if not _DEPTH[0]:
                spark.conf.set(_CLEANUP, _BEFORE[0])


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that ``cut`` wrote, once all that derives from them is written itself."""
    for df in tables:
        if df is not None and (path := _WRITTEN.pop(df, None)):
            _remove(df.sparkSession, path)


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, exact (on-disk bytes) for a table that ``cut`` wrote."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
