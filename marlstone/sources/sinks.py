"""Outputs that appear whole or not at all, and never replace what is there."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_EXPORT = 8 * 1024 * 1024


def _sorted_struct(df: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def jsonl(df: DataFrame) -> DataFrame:
    """One column `value`: each row as JSON with sorted keys; nulls are written."""
    return df.select(F.to_json(_sorted_struct(df), {"ignoreNullFields": "false"}).alias("value"))


def publish(frames: dict[str, DataFrame], target: str, kind: str = "parquet") -> None:
    """Write all frames under a staging folder beside `target` and rename it at the end;
    FileExistsError if the target is there. kind: parquet, jsonl or tsv."""
    spark = next(iter(frames.values())).sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(target)
    staging = hadoop.Path(f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}")
    try:
        for name, df in frames.items():
            place = f"{staging}/{name}"
            if kind == "jsonl":
                jsonl(df).write.text(place)
            elif kind == "tsv":
                df.write.option("sep", "\t").option("header", "true").csv(place)
            else:
                df.write.parquet(place)
        if not fs.rename(staging, path):
            raise FileExistsError(target)
    finally:
        fs.delete(staging, True)


def export_json(value: object, path: str) -> None:
    """Write JSON to a new local file of the driver, private to its owner: a temporary file
    is synced and then linked, so the name never shows half a file. ValueError over 8 MiB."""
    data = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False).encode()
    if len(data) > MAX_EXPORT:
        raise ValueError("the export is larger than 8 MiB")
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as out:
            os.fchmod(out.fileno(), 0o600)
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.link(name, path)
    finally:
        os.unlink(name)


def write_index(postings: DataFrame, target: str, buckets: int = 64, parts: int = 1) -> None:
    """A search index: postings (id, token, tf, length) in folders by a hash of the token,
    so a query reads the folders of its words only, and in them, as files are sorted by token,
    the parts that may hold them. `parts` tasks write each folder."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    placed = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket", part).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(target)


def read_index(spark: SparkSession, target: str, words: list[str], buckets: int = 64) -> DataFrame:
    """The postings of the words."""
    hashes = spark.createDataFrame([(w,) for w in words] or [("",)], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).collect()
    return spark.read.parquet(target).filter(F.col("bucket").isin(sorted({r.b for r in hashes})) & F.col("token").isin(words)).drop("bucket")
