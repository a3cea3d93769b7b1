"""Session factory and table access."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app: str = "marlstone", **conf: str) -> SparkSession:
    """A session with the settings every operator here expects: UTC, AQE with skew
    handling, and Arrow batches bounded in bytes rather than rows alone.

    `conf` keys use double underscores for dots (``spark__sql__shuffle__partitions="64"``).
    On a cluster leave `master` unset and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()
#: Limits of an Arrow batch. Rows may hold long texts, and batches are held several times
#: over on their way between the JVM and Python.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers
    can import it wherever they start, and bound Arrow batches where the session does not."""
    context = spark.sparkContext
    for key, value in _BATCHES.items():
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="marlstone-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's reader touches the path, so any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
