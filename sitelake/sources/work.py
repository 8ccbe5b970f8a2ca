"""A place for tables that a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Batches between Spark and Python hold so many bytes at most, so that two tasks of a small executor fit.
BATCH_BYTES = 8 << 20

#: Every path given out by this driver that hasn't been removed, in order.
_made: dict[str, None] = {}
_lock = threading.Lock()
#: The paths given out within the innermost scope. A new thread begins outside of any.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the size of Arrow batches to BATCH_BYTES, if it is higher. It stays so for what the
    session runs later: Spark reads it when a plan runs, not when it is made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (dots written as __) that hold for what is planned and run inside; they come back after."""
    own = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir), to be removed by the scope it is made in or
    by remove_tables(). Only where that setting is unset and Spark runs in this machine alone, as in tests, a
    temporary folder takes its place."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sitelake-"))
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _lock:
        _made[path] = None
    if (own := _scope.get()) is not None:
        own.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and no executor's loss reaches it."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        with _lock:
            _made.pop(path, None)


def is_kept(path: str) -> bool:
    """Whether a path was given out and hasn't been removed since."""
    return path in _made


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """What this thread writes inside is removed at the end, but for paths taken off the list. Other threads' tables stay."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        remove(spark, own)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of make() as a table; the tables that this thread wrote on the way to it are removed."""
    spark = SparkSession.active()
    with scope(spark) as own:
        out = written(make(), name)
        path = own.pop()  # written last
    if (outer := _scope.get()) is not None:
        outer.append(path)
    return out


def remove_tables(spark: SparkSession) -> None:
    """Remove all that was written below paths given out so far; for the end of a job, when its results have been taken."""
    remove(spark, [*_made])
