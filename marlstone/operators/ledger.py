"""Ledger analytics: balances, flows, queues, lookups and checks over any ledger tables.

Amounts are integers in minor units. Everything is declarative: fact tables are summed
up on the join key before they are joined, so a join moves one row a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def minor(amount: Column) -> Column:
    """A decimal amount held as a double, in integer minor units."""
    return F.round(amount * 100).cast("long")


def month(at: Column) -> Column:
    """The yyyy-MM of a timestamp."""
    return F.date_format(at, "yyyy-MM")


def balances(accounts: DataFrame, entries: DataFrame, key: str, amount: Column, at: Column) -> DataFrame:
    """`accounts` with balance_minor (0 without entries) and last_posted_at; `key` names the
    account in both."""
    sums = entries.groupBy(key).agg(F.sum(amount).alias("balance_minor"), F.max(at).alias("last_posted_at"))
    return accounts.join(sums, key, "left").withColumn("balance_minor", F.coalesce("balance_minor", F.lit(0)).cast("long"))


def monthly_flow(entries: DataFrame, key: str, at: Column, inflow: Column, outflow: Column) -> DataFrame:
    """Per key and month: inflow_minor, outflow_minor, net_flow_minor and the net of the
    key's month before in the data (null in its first)."""
    by_month = entries.groupBy(key, month(at).alias("posting_month")).agg(
        F.sum(inflow).cast("long").alias("inflow_minor"), F.sum(outflow).cast("long").alias("outflow_minor"))
    net = by_month.withColumn("net_flow_minor", F.col("inflow_minor") - F.col("outflow_minor"))
    order = Window.partitionBy(key).orderBy("posting_month")
    return net.withColumn("previous_month_net_minor", F.lag("net_flow_minor").over(order))


def top(df: DataFrame, by: Column, ties: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows by descending `by`; ties go by the columns named."""
    return df.orderBy(by.desc(), *ties).limit(n)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each value of the keys: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def convert_latest(amounts: DataFrame, rates: DataFrame, pair: Sequence[str], at: str, amount: str, rate: str, scale: int = 1_000_000) -> DataFrame:
    """`amounts` with rate_used and converted_minor by the newest rate of the pair; the
    product, which may be larger than a long, is divided by the scale towards zero. No rate gives nulls."""
    newest = rates.groupBy(*pair).agg(F.max_by(rate, at).alias("rate_used"))
    out = amounts.join(newest, list(pair), "left")
    return out.withColumn("converted_minor", F.expr(f"(cast({amount} as decimal(19,0)) * cast(rate_used as decimal(19,0))) div {scale}"))


def linked_totals(items: DataFrame, links: DataFrame, key: str, amount: Column) -> DataFrame:
    """`items` with the number and total of their links, 0 without any."""
    sums = links.groupBy(key).agg(F.count("*").alias("linked_count"), F.sum(amount).alias("linked_minor"))
    return items.join(sums, key, "left").withColumns({
        "linked_count": F.coalesce("linked_count", F.lit(0)).cast("long"), "linked_minor": F.coalesce("linked_minor", F.lit(0)).cast("long")})


def arrears(installments: DataFrame, keys: Sequence[str], late: Column, due: Column, at: Column) -> DataFrame:
    """Per key: late_count, arrears_minor and oldest_late_at (null when nothing is late)."""
    return installments.groupBy(*keys).agg(
        F.count_if(late).cast("long").alias("late_count"), F.coalesce(F.sum(F.when(late, due)), F.lit(0)).cast("long").alias("arrears_minor"),
        F.min(F.when(late, at)).alias("oldest_late_at"))


def rapid(entries: DataFrame, key: str, at: str, least: int, window: str = "1 DAY") -> DataFrame:
    """Entries that are at least the `least`-th of their key within the window that ends
    with them, with in_window, their number in it."""
    count = F.expr(f"count(*) over (partition by {key} order by {at} range between interval {window} preceding and current row)")
    return entries.withColumn("in_window", count.cast("long")).filter(F.col("in_window") >= least)


def followed_within(first: DataFrame, second: DataFrame, key: str, first_at: str, second_at: str, window: str) -> DataFrame:
    """Pairs of rows of one key where the second comes after the first, within the window
    (a whole number of days, as in "7 DAY").

    The rows are joined on the key and a bucket of time as long as the window; each second
    row is looked for in its own bucket and the one before. A busy key is thus spread over
    buckets and compared with near rows only.
    """
    days = int(window.split()[0])
    bucket = lambda at: F.floor(F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date")) / days).cast("long")
    first = first.withColumn("_bucket", bucket(first_at))
    second = second.withColumn("_bucket", F.explode(F.array(bucket(second_at), bucket(second_at) - 1)))
    condition = (F.col(second_at) > F.col(first_at)) & (F.col(second_at) <= F.col(first_at) + F.expr(f"interval {window}"))
    return first.join(second, [key, "_bucket"]).filter(condition).drop("_bucket")


def share_gaps(holders: DataFrame, key: str, share: Column, total: int = 100) -> DataFrame:
    """Keys with several holders whose shares do not add up to the total."""
    sums = holders.groupBy(key).agg(F.count("*").alias("holders"), F.sum(share).cast("long").alias("share_sum"))
    return sums.filter((F.col("holders") > 1) & (F.col("share_sum") != total))


def outcome_rates(df: DataFrame, by: Sequence[str], good: Column, bad: Column) -> DataFrame:
    """Per group: rows, good_count, bad_count and their shares in parts per 10,000."""
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(good).cast("long").alias("good_count"), F.count_if(bad).cast("long").alias("bad_count"))
    return counts.withColumns({"good_bps": F.expr("(good_count * 10000) div rows"), "bad_bps": F.expr("(bad_count * 10000) div rows")})


def unbalanced(entries: DataFrame, key: str, amount: Column) -> DataFrame:
    """Keys whose entries do not add up to zero."""
    return entries.groupBy(key).agg(F.sum(amount).cast("long").alias("difference")).filter("difference <> 0")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of `child` whose non-null key has no row in `parent`."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule is false or null; all rules in one scan."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).cast("long").alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest): a digest of the values that no order of rows changes: the sum of the
    leading 60 bits of each row's sha256, as text."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("digest"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, percent: int = 95) -> DataFrame:
    """Per group: n, mean_value and the nearest-rank percentile `p_value`."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"),
                               F.expr(f"percentile_disc({percent / 100}) within group (order by {value})").alias("p_value"))


def throughput(df: DataFrame, by: Sequence[str], value: str, at: str, percent: int = 95) -> DataFrame:
    """`nearest_rank` and `per_second`: the rows over the seconds that they span; null for no span."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = micros(F.max(at)) - micros(F.min(at))
    speed = df.groupBy(*by).agg(F.round(F.count("*") / F.nullif(span, F.lit(0)) * 1_000_000, 9).alias("per_second"))
    return nearest_rank(df, by, value, percent).join(speed, list(by))


def request_counters(df: DataFrame, by: Sequence[str], failed: Column, seconds: Column) -> DataFrame:
    """Per group: how many requests, how many failed, and the seconds they took together."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.round(F.sum(seconds), 6).alias("seconds"))
