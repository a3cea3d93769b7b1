"""Cutting lineage with tables written to the folder all executors share.

A written table survives lost executors: a task that is tried again reads the
files, never another executor's memory. The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (local tests) is one chosen here.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    """A folder of this process, removed when it ends; for local masters only."""
    folder = tempfile.mkdtemp(prefix="marlstone-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local default is allowed for local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` as Parquet to the shared folder and return a frame that reads it.

    On a cluster the table stays until it is discarded or the folder is emptied, as the
    frames that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _held:
        _held[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are materialised inside are deleted at the end, but for those that are
    taken off the list; nothing that still reads them may be used after that."""
    paths: list[str] = []
    _held.append(paths)
    try:
        yield paths
    finally:
        _held.remove(paths)
        for path in paths:
            _delete(spark, path)


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """`materialize` a frame that has tables of its own behind it, once all its work is done:
    those made since the enclosing `scratch` began are deleted with it, this one stays."""
    out = materialize(df, label)
    if _held:
        _held[-1].pop()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that `materialize` returned, once nothing reads it."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            _delete(spark, folder)
