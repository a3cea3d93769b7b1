from collections import Counter

from marlstone.operators import skew
from pyspark.sql import functions as F


def test_salted_join_is_the_plain_join(spark):
    rows = spark.createDataFrame([(k % 5 if k % 3 else 7, k) for k in range(9000)] + [(None, 1)], "k int, v int")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).filter("n > 1 and k <> 2")
    total = skew.total_of(keys, "n")
    got = skew.salted_join(rows, keys, ["k"], "n", total, ["v"])
    assert got.columns == ["k", "v", "least"]
    want = rows.join(keys.drop("n"), "k")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert skew.salted_join(rows, keys.limit(0), ["k"], "n", 0, ["v"]).isEmpty()


def test_running_totals_over_ranges(spark):
    from pyspark.sql import functions as F

    from marlstone.operators.ranges import running_total

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v")).repartition(8)
    rows = {r.k: (r.v, r.t) for r in running_total(df, "k", F.col("v"), "t").collect()}
    total = 0
    for k in range(1000):
        total += rows[k][0]
        assert rows[k][1] == total
    assert running_total(df.limit(0), "k", F.col("v"), "t").isEmpty()
