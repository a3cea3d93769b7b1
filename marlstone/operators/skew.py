"""An equi-join whose hot keys are spread over many tasks.

AQE splits a skewed join only where both sides come straight from an exchange; a side that
was just aggregated on the join key does not. Here the counts of that aggregation tell
which keys are hot. Their number is bounded by arithmetic: a key is hot if it has more
rows than `per`, and `per` is at least the total over `MOST_HOT`, so at most `MOST_HOT`
keys are hot at any size, and the table that is broadcast has a proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT, LEAST_ROWS = 10_000, 1_000


def salted_join(rows: DataFrame, keys: DataFrame, on: Sequence[str], count: str, total: int, spread: Sequence[str]) -> DataFrame:
    """Inner join of `rows` with `keys`, which holds each key once with the `count` of its
    rows; `total` is the sum of the counts. The rows of a hot key are dealt by a hash of
    the `spread` columns to as many parts as it takes, and the key's one row is copied to
    each part. `keys` is read twice, so it should be a written table. `count` is dropped.
    """
    per = max(LEAST_ROWS, -(-total // MOST_HOT))
    parted = keys.withColumn("_parts", F.ceil(F.col(count) / per).cast("int"))
    hot = parted.filter("_parts > 1").select(*on, F.col("_parts").alias("_hot"))
    dealt = rows.join(F.broadcast(hot), list(on), "left").withColumn("_part", F.pmod(F.xxhash64(*spread), F.coalesce("_hot", F.lit(1))).cast("int")).drop("_hot")
    copied = parted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", count)
    return dealt.join(copied, [*on, "_part"]).drop("_part")


def total_of(keys: DataFrame, count: str) -> int:
    """The sum of the counts, 0 for no keys."""
    return keys.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
