"""Small versioned tables: each version is a folder of its own that readers see once it is whole.

A version is written as Parquet to path/v=<number>, and counts from the moment Spark's job commits it (its _SUCCESS
file, which must not be switched off). Nothing that a reader of the version before uses is touched, so it goes on undisturbed, and a
writer that dies leaves nothing to see. One writer at a time: of two that publish the same number, one fails.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def children(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of what is directly below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(str(s.getPath().toString()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions, in order."""
    found = [int(m[1]) for p, _, _ in children(spark, path) if (m := re.search(r"/v=(\d+)$", p)) and exists(spark, f"{p}/_SUCCESS")]
    return sorted(found)


def at_version(path: str, version: int) -> str:
    return f"{path}/v={version:010d}"


def publish(df: DataFrame, path: str, version: int) -> None:
    """Write a version. What a writer that died has left of it is replaced; a whole one is an error."""
    target = at_version(path, version)
    if exists(df.sparkSession, f"{target}/_SUCCESS"):
        raise ValueError(f"{target} has been written before")
    df.write.mode("overwrite").parquet(target)


def latest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """(number, rows) of the newest version; 0 and none if there is none."""
    found = versions(spark, path)
    return (found[-1], spark.read.parquet(at_version(path, found[-1]))) if found else (0, None)


def state_of(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files have changed: their names, lengths and times. A file or a flat folder."""
    own = children(spark, path)
    return tuple(sorted(own))
