"""Running totals and percentiles over a whole table without bringing it into one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.plans.materialize import materialize


def running_total(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """`df` and the sum of `value` over all rows up to each, by the unique column `order`.

    Rows are sorted in ranges; each range adds the sum of the ranges before it, which is a
    table of one row a range, to the running total within itself.
    """
    ranged = materialize(df.withColumn("_value", value).repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + own).drop("_value", "_range", "_start")


def percentiles(df: DataFrame, group: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """One row per `group` with the exact percentiles of `value`, interpolated: a column a share.

    Equal values are counted first, and the counts are sorted in ranges of (group, value). A range
    adds the number of its group's rows in the ranges before it, a table of a row a range and group,
    to the running count within itself, so no task holds a group. Null values have no place; a
    group without others has nulls.
    """
    counted = df.groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).agg(F.count(value).alias("n"))
    ranged = materialize(counted.repartitionByRange("g", "x").withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range", "g").agg(F.sum("n").alias("_sum"))
    by_group = Window.partitionBy("g")
    before = F.sum("_sum").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("_range").alias("_r"), F.col("g").alias("_g"), F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_sum").over(by_group).alias("_all"))
    own = F.sum("n").over(Window.partitionBy("_range", "g").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("_own", own).join(F.broadcast(starts), (F.col("_range") == F.col("_r")) & F.col("g").eqNullSafe(F.col("_g")))
    placed = placed.withColumn("_upto", F.col("_start") + F.col("_own")).withColumn("_from", F.col("_upto") - F.col("n"))
    ends = []
    for name, share in shares.items():
        at = (F.col("_all") - 1).cast("double") * share
        ends += [F.max(F.when((F.col("_from") <= whole) & (whole < F.col("_upto")), F.col("x"))).alias(f"_{name}_{side}") for side, whole in (("low", F.floor(at)), ("high", F.ceil(at)))]
        ends.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
    found = placed.groupBy("g").agg(*ends)
    return found.select(F.col("g").alias(group), *[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n) for n in shares])
