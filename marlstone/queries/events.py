"""Windowed event queries, run as batches here; the same functions take streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table
from marlstone.streaming import rapid


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rapid_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows, sliding by six hours, with five events of a user or more."""
    out = rapid.rapid_windows(_stamped(spark, d), least=5, slide="6 hours")
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("events"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user with gaps of six hours at most, by their number of events."""
    return rapid.sessions(_stamped(spark, d), gap="6 hours").groupBy("events").agg(F.count("*").alias("sessions"))


QUERIES = {f.__name__: f for f in (rapid_windows, event_sessions)}

ORACLE_SQL = {
    "rapid_windows": """select user_id, s as window_start, count(*) as events from (
        select user_id, unnest([time_bucket(interval 6 hour, ts) - to_hours(6 * k) for k in range(4)]) as s from events) group by 1, 2 having count(*) >= 5""",
    "event_sessions": """select n as events, count(*) as sessions from (select user_id, sid, count(*) as n from (
        select user_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from (
          select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events)) group by 1, 2) group by 1""",
}
