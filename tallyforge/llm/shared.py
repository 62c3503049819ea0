"""The folder that driver and executors share, and tables written there to cut lineage.

The folder is the one the session names in ``spark.checkpoint.dir``.  Where that is unset, a
session on one machine (master ``local``) gets a temporary one; any other session is refused,
as its executors would each write to their own disk.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_single: dict[str, str] = {}  # temporary folders of sessions on one machine, by application


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        app = spark.sparkContext.applicationId
        if app not in _single:
            _single[app] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        found = _single[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Blocks(threading.local):
    """The open ``temporary`` blocks of a thread, and the tables that belong to each."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_blocks = _Blocks()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread saves inside are deleted at the end, but for those that are kept."""
    _blocks.open.append([])
    try:
        yield
    finally:
        for path in _blocks.open.pop():
            delete(spark, path)


def save(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: later jobs start from the files.

    ``keep``: it outlives the innermost ``temporary`` block (and belongs to the one around it).
    """
    path = write(df, name)
    around = _blocks.open[:-1] if keep else _blocks.open
    if around:
        around[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
