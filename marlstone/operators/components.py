"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is
two aggregations with map-side combine and two joins that spread hot keys, so a node
with very many neighbours never has to meet them all in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.skew import salted_join
from marlstone.plans.materialize import discard, materialize


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    linked = salted_join(both.filter("v > u"), low, ["u"], "n", 2 * count, ["v"])
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = salted_join(down, low, ["u"], "n", count, ["v"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v of one orderable type).

    component is the least node of the component. Self loops, repeated and null edges
    are allowed and ignored; nodes that appear only in those are not returned. Raises
    RuntimeError if `max_rounds` do not converge, rather than returning partial groups.
    """
    current = materialize(
        edges.select("u", "v").filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, count = None, current.count()
    for _ in range(max_rounds):
        # the large star makes at most one edge of each edge's two directions
        after = materialize(_small_star(_large_star(current, count), count), "edges")
        row = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"),
                        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        discard(current)
        current = after
        if tuple(row) == mark:
            break
        mark, count = tuple(row), row["n"]
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
