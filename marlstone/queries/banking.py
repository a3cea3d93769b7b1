"""Banking shapes on the star schema: customers are account holders, orders are ledger
transactions (status F credits, O debits, P pending), line items are installments or
linked transactions, nations are branches, and events are payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import ledger
from marlstone.session import table

def _price() -> Column:
    return F.col("o_totalprice")



def _signed() -> Column:
    return F.when(F.col("o_orderstatus") == "O", -ledger.minor(_price())).otherwise(ledger.minor(_price()))


_SIGNED = "case when o_orderstatus = 'O' then -cast(round(o_totalprice * 100) as bigint) else cast(round(o_totalprice * 100) as bigint) end"


def _balances(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return ledger.balances(table(spark, d, "customer"), entries, "c_custkey", _signed(), F.col("o_orderdate"))


_BALANCES = f"""(select c.*, cast(coalesce(b, 0) as bigint) as balance_minor, last_posted_at from customer c left join
  (select o_custkey, sum({_SIGNED}) as b, max(o_orderdate) as last_posted_at from orders group by 1) o on c.c_custkey = o.o_custkey)"""


def account_balances(spark: SparkSession, d: str) -> DataFrame:
    """Balance and last posting of every customer, customers without orders included."""
    return _balances(spark, d).select("c_custkey", "c_name", "c_mktsegment", "balance_minor", "last_posted_at")


def top_abs_balances(spark: SparkSession, d: str) -> DataFrame:
    """The 25 largest absolute balances with the holder's branch."""
    named = _balances(spark, d).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ledger.top(named, F.abs("balance_minor"), ["c_custkey"], 25).select("n_name", "c_custkey", "c_name", "balance_minor")


def customer_account_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per branch: holders with activity, balance of one segment, and last activity."""
    b = _balances(spark, d)
    return b.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(
        F.count_distinct(F.when(F.col("last_posted_at").isNotNull(), F.col("c_custkey"))).alias("account_count"),
        F.coalesce(F.sum(F.when(F.col("c_mktsegment") == "FURNITURE", F.col("balance_minor")).otherwise(0)), F.lit(0)).cast("long").alias("primary_balance_minor"),
        F.max("last_posted_at").alias("last_activity_at"))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    credit = F.when(F.col("o_orderstatus") != "O", ledger.minor(_price())).otherwise(F.lit(0))
    debit = F.when(F.col("o_orderstatus") == "O", ledger.minor(_price())).otherwise(F.lit(0))
    return ledger.monthly_flow(table(spark, d, "orders"), "o_custkey", F.col("o_orderdate"), credit, debit)


_FLOW = """(select *, lag(net_flow_minor) over (partition by o_custkey order by posting_month) as previous_month_net_minor from (
  select *, inflow_minor - outflow_minor as net_flow_minor from (select o_custkey, strftime(o_orderdate, '%Y-%m') as posting_month,
    cast(sum(case when o_orderstatus <> 'O' then cast(round(o_totalprice * 100) as bigint) else 0 end) as bigint) as inflow_minor,
    cast(sum(case when o_orderstatus = 'O' then cast(round(o_totalprice * 100) as bigint) else 0 end) as bigint) as outflow_minor
  from orders group by 1, 2)))"""


def monthly_cash_flow(spark: SparkSession, d: str) -> DataFrame:
    """Inflow, outflow and net of each customer's months beside the month before."""
    return _flow(spark, d)


def month_over_month(spark: SparkSession, d: str) -> DataFrame:
    """The 25 largest movements of the net from one month to the next."""
    moved = _flow(spark, d).filter("previous_month_net_minor is not null")
    return ledger.top(moved, F.abs(F.col("net_flow_minor") - F.col("previous_month_net_minor")), ["o_custkey", "posting_month"], 25).select(
        "o_custkey", "posting_month", "net_flow_minor", "previous_month_net_minor")


def latest_month_per_account(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's newest month."""
    return ledger.latest_per(_flow(spark, d), ["o_custkey"], [F.desc("posting_month")]).select("o_custkey", "posting_month", "net_flow_minor")


def open_alert_queue(spark: SparkSession, d: str) -> DataFrame:
    """Open orders of high priority with their line items' number and total."""
    items = table(spark, d, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    open_ = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return ledger.linked_totals(open_, items, "o_orderkey", ledger.minor(F.col("l_extendedprice"))).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "linked_count", "linked_minor")


def arrears_by_branch(spark: SparkSession, d: str) -> DataFrame:
    """Exposure of orders with returned items: per order first, then per branch and segment."""
    late, due = F.col("l_returnflag") == "R", ledger.minor(F.col("l_extendedprice")) - ledger.minor(F.col("l_extendedprice") * F.col("l_discount"))
    loans = ledger.arrears(table(spark, d, "lineitem"), ["l_orderkey"], late, due, F.col("l_shipdate")).filter("arrears_minor > 0")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    held = loans.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return held.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count("*").alias("delinquent_loans"), F.sum("late_count").cast("long").alias("late_count"),
        F.sum("arrears_minor").cast("long").alias("arrears_minor"), F.min("oldest_late_at").alias("oldest_late_at"))


def reversal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Returned line items beside the kept items of the same order, newest 50."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    r, o = items.filter("l_returnflag = 'R'").alias("r"), items.filter("l_returnflag = 'N'").alias("o")
    pairs = r.join(o, F.col("r.l_orderkey") == F.col("o.l_orderkey")).select(
        F.col("r.l_orderkey").alias("order_key"), F.col("r.l_linenumber").alias("reversal_line"), F.col("o.l_linenumber").alias("original_line"),
        F.col("r.l_partkey").alias("reversal_part"), F.col("o.l_partkey").alias("original_part"),
        ledger.minor(F.col("r.l_extendedprice")).alias("amount_minor"), F.col("r.l_shipdate").alias("booked_at"))
    return ledger.top(pairs, F.col("booked_at"), ["order_key", "reversal_line", "original_line", "reversal_part", "original_part", "amount_minor"], 50)


def result_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first 10,000 line items in key order: what a capped result holds."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(10_000)


def ledger_balance_check(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose debit (the total) and credits (net line items) differ: number and sum."""
    debit = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (-ledger.minor(_price())).alias("amount"))
    credit = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), ledger.minor(F.col("l_extendedprice")).alias("amount"))
    return ledger.unbalanced(debit.unionByName(credit), "k", F.col("amount")).agg(
        F.count("*").alias("unbalanced"), F.sum("difference").cast("long").alias("difference"))


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of orders and line items that break a check constraint, per rule."""
    o = ledger.violations(table(spark, d, "orders"), {
        "order_status_known": F.col("o_orderstatus").isin("O", "F", "P"), "order_total_positive": _price() > 0,
        "order_priority_shape": F.col("o_orderpriority").rlike("^[1-5]-[A-Z ]+$")})
    items = ledger.violations(table(spark, d, "lineitem"), {
        "line_quantity_range": F.col("l_quantity").between(1, 50), "line_discount_small": F.col("l_discount") <= 0.05,
        "line_flag_known": F.col("l_returnflag").isin("A", "N", "R")})
    return o.unionByName(items)


def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Per foreign key: rows without a parent."""
    t = lambda name: table(spark, d, name)
    keys = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
            ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for child, ck, parent, pk in keys:
        one = ledger.orphans(t(child), t(parent), ck, pk).agg(F.count("*").alias("orphans")).select(F.lit(f"{child}.{ck}").alias("foreign_key"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


def ownership_not_100(spark: SparkSession, d: str) -> DataFrame:
    """Orders with several line items whose shares of the quantity, as rounded percentages, do not sum to 100."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    total = items.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    share = F.floor(F.col("l_quantity") * 100 / F.col("q")).cast("long")
    return ledger.share_gaps(items.join(total, "l_orderkey"), "l_orderkey", share)


def latest_rate_convert(spark: SparkSession, d: str) -> DataFrame:
    """Balances per segment converted by the newest rate of the segment's pair."""
    b = _balances(spark, d).groupBy(F.col("c_mktsegment").alias("pair")).agg(F.sum("balance_minor").cast("long").alias("amount"))
    rates = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("pair"), F.col("o_orderdate").alias("rate_date")).agg((F.lit(800000) + F.max("o_orderkey") % 400000).alias("rate_micros"))
    return ledger.convert_latest(b, rates, ["pair"], "rate_date", "amount", "rate_micros")


def rank_branches(spark: SparkSession, d: str) -> DataFrame:
    """Branches ranked by the number of holders, then by balance."""
    from pyspark.sql.window import Window

    b = _balances(spark, d).groupBy("c_nationkey").agg(F.count("*").alias("holders"), F.sum("balance_minor").cast("long").alias("balance_minor"))
    order = Window.orderBy(F.desc("holders"), F.desc("balance_minor"))
    return b.withColumn("place", F.rank().over(order).cast("long"))


def rapid_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Purchases that are the third or later of their user within a day."""
    payments = table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return ledger.rapid(payments, "user_id", "ts", 3)


def event_before_event(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups followed by a purchase of the same user within two days."""
    e = table(spark, d, "events")
    first = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_at"))
    second = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_at"))
    return ledger.followed_within(first, second, "user_id", "signup_at", "purchase_at", "2 DAY")


def decision_rates(spark: SparkSession, d: str) -> DataFrame:
    """Finished and open shares of orders by priority."""
    return ledger.outcome_rates(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


def dormant_activity(spark: SparkSession, d: str) -> DataFrame:
    """Line items shipped more than 60 days after their customer's last order."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_activity_at"))
    owner = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(last, "o_custkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return items.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate > last_activity_at + interval 60 day").select(
        "o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "last_activity_at")


def json_field_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events whose props hold a k of 90 or more, per type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").filter(k >= 90).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).cast("long").alias("k_sum"))


def integrity_digest(spark: SparkSession, d: str) -> DataFrame:
    """Order-free digests of tables with exact columns."""
    out = None
    for name, columns in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]),
                          ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])):
        one = ledger.table_digest(table(spark, d, name), columns).select(F.lit(name).alias("table_name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile of the events' value by type."""
    return ledger.nearest_rank(table(spark, d, "events"), ["event_type"], "value")


def cube_activity(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and priority with all subtotals."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("orders"), F.sum(ledger.minor(_price())).cast("long").alias("total_minor"), F.grouping_id().cast("long").alias("level"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Customers with finished but no open orders, and those with both, by set operators."""
    o = table(spark, d, "orders")
    done, open_ = o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderstatus = 'O'").select("o_custkey")
    return done.subtract(open_).withColumn("kind", F.lit("finished only")).union(done.intersect(open_).withColumn("kind", F.lit("both")))


QUERIES = {f.__name__: f for f in (
    account_balances, top_abs_balances, customer_account_summary, monthly_cash_flow, month_over_month, latest_month_per_account,
    open_alert_queue, arrears_by_branch, reversal_pairs, result_cap, ledger_balance_check, constraint_violations, fk_orphans,
    ownership_not_100, latest_rate_convert, rank_branches, rapid_transfers, event_before_event, decision_rates, dormant_activity,
    json_field_filter, integrity_digest, latency_p95, cube_activity, set_operations)}

_DIGEST = "select '{0}' as table_name, count(*) as rows, cast(sum(cast(('0x' || substr(sha256(concat_ws('|', {1})), 1, 15)) as bigint)) as varchar) as digest from {0}"
_RULE = "select '{1}' as rule, count(*) filter (where not coalesce({2}, false)) as violations from {0}"
_FK = "select '{0}.{1}' as foreign_key, count(*) as orphans from {0} where {1} is not null and {1} not in (select {3} from {2})"

ORACLE_SQL = {
    "account_balances": f"select c_custkey, c_name, c_mktsegment, balance_minor, last_posted_at from {_BALANCES}",
    "top_abs_balances": f"select n_name, c_custkey, c_name, balance_minor from {_BALANCES} join nation on c_nationkey = n_nationkey order by abs(balance_minor) desc, c_custkey limit 25",
    "customer_account_summary": f"""select n_nationkey, n_name, count(distinct case when last_posted_at is not null then c_custkey end) as account_count,
        cast(coalesce(sum(case when c_mktsegment = 'FURNITURE' then balance_minor else 0 end), 0) as bigint) as primary_balance_minor, max(last_posted_at) as last_activity_at
        from {_BALANCES} join nation on c_nationkey = n_nationkey group by 1, 2""",
    "monthly_cash_flow": f"select * from {_FLOW}",
    "month_over_month": f"""select o_custkey, posting_month, net_flow_minor, previous_month_net_minor from {_FLOW} where previous_month_net_minor is not null
        order by abs(net_flow_minor - previous_month_net_minor) desc, o_custkey, posting_month limit 25""",
    "latest_month_per_account": f"select o_custkey, posting_month, net_flow_minor from {_FLOW} qualify row_number() over (partition by o_custkey order by posting_month desc) = 1",
    "open_alert_queue": """select o_orderkey, o_custkey, o_orderpriority, o_orderdate, count(l_orderkey) as linked_count,
        cast(coalesce(sum(cast(round(l_extendedprice * 100) as bigint)), 0) as bigint) as linked_minor from orders left join lineitem on o_orderkey = l_orderkey
        where o_orderstatus in ('O', 'P') and o_orderpriority in ('1-URGENT', '2-HIGH') group by 1, 2, 3, 4""",
    "arrears_by_branch": """with loans as (select l_orderkey, count(*) filter (where l_returnflag = 'R') as late_count,
          cast(coalesce(sum(case when l_returnflag = 'R' then cast(round(l_extendedprice * 100) as bigint) - cast(round(l_extendedprice * l_discount * 100) as bigint) end), 0) as bigint) as arrears_minor,
          min(case when l_returnflag = 'R' then l_shipdate end) as oldest_late_at from lineitem group by 1)
        select c_nationkey, c_mktsegment, count(*) as delinquent_loans, cast(sum(late_count) as bigint) as late_count, cast(sum(arrears_minor) as bigint) as arrears_minor,
          min(oldest_late_at) as oldest_late_at from loans join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where arrears_minor > 0 group by 1, 2""",
    "reversal_pairs": """select r.l_orderkey as order_key, r.l_linenumber as reversal_line, o.l_linenumber as original_line, r.l_partkey as reversal_part, o.l_partkey as original_part,
        cast(round(r.l_extendedprice * 100) as bigint) as amount_minor, r.l_shipdate as booked_at from lineitem r join lineitem o on r.l_orderkey = o.l_orderkey
        where r.l_returnflag = 'R' and o.l_returnflag = 'N' order by booked_at desc, 1, 2, 3, 4, 5, 6 limit 50""",
    "result_cap": "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem order by 1, 2, 3, 4 limit 10000",
    "ledger_balance_check": """select count(*) as unbalanced, cast(sum(d) as bigint) as difference from (select k, sum(amount) as d from (
        select o_orderkey as k, -cast(round(o_totalprice * 100) as bigint) as amount from orders union all
        select l_orderkey, cast(round(l_extendedprice * 100) as bigint) from lineitem) group by 1 having sum(amount) <> 0)""",
    "constraint_violations": " union all ".join(_RULE.format(*r) for r in (
        ("orders", "order_status_known", "o_orderstatus in ('O', 'F', 'P')"), ("orders", "order_total_positive", "o_totalprice > 0"),
        ("orders", "order_priority_shape", "regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')"), ("lineitem", "line_quantity_range", "l_quantity between 1 and 50"),
        ("lineitem", "line_discount_small", "l_discount <= 0.05::double"), ("lineitem", "line_flag_known", "l_returnflag in ('A', 'N', 'R')"))),
    "fk_orphans": " union all ".join(_FK.format(*k) for k in (
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"))),
    "ownership_not_100": """select l_orderkey, count(*) as holders, cast(sum(s) as bigint) as share_sum from (select l_orderkey,
        cast(floor(l_quantity * 100 / sum(l_quantity) over (partition by l_orderkey)) as bigint) as s from lineitem) group by 1 having count(*) > 1 and sum(s) <> 100""",
    "latest_rate_convert": f"""with b as (select c_mktsegment as pair, cast(sum(balance_minor) as bigint) as amount from {_BALANCES} group by 1),
        r as (select c_mktsegment as pair, o_orderdate as rate_date, 800000 + max(o_orderkey) % 400000 as rate_micros from orders join customer on o_custkey = c_custkey group by 1, 2),
        n as (select pair, rate_micros as rate_used from r qualify row_number() over (partition by pair order by rate_date desc) = 1)
        select pair, amount, rate_used, cast(sign(amount) * (abs(amount) * rate_used // 1000000) as bigint) as converted_minor from b left join n using (pair)""",
    "rank_branches": f"""select *, rank() over (order by holders desc, balance_minor desc) as place from (select c_nationkey, count(*) as holders,
        cast(sum(balance_minor) as bigint) as balance_minor from {_BALANCES} group by 1)""",
    "rapid_transfers": """select * from (select event_id, user_id, ts, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as in_window
        from events where event_type = 'purchase') where in_window >= 3""",
    "event_before_event": """select a.user_id, a.event_id as signup_id, a.ts as signup_at, b.event_id as purchase_id, b.ts as purchase_at from events a join events b on a.user_id = b.user_id
        where a.event_type = 'signup' and b.event_type = 'purchase' and b.ts > a.ts and b.ts <= a.ts + interval 2 day""",
    "decision_rates": """select *, (good_count * 10000) // rows as good_bps, (bad_count * 10000) // rows as bad_bps from (select o_orderpriority, count(*) as rows,
        count(*) filter (where o_orderstatus = 'F') as good_count, count(*) filter (where o_orderstatus = 'O') as bad_count from orders group by 1)""",
    "dormant_activity": """select o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, last_activity_at from lineitem join orders on l_orderkey = o_orderkey
        join (select o_custkey, max(o_orderdate) as last_activity_at from orders group by 1) using (o_custkey) where l_shipdate > last_activity_at + interval 60 day""",
    "json_field_filter": """select event_type, count(*) as n, cast(sum(k) as bigint) as k_sum from (select event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events)
        where k >= 90 group by 1""",
    "integrity_digest": " union all ".join(_DIGEST.format(t, ", ".join(f"coalesce(cast({c} as varchar), chr(92) || 'N')" for c in cs)) for t, cs in (
        ("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]), ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))),
    "latency_p95": "select event_type, count(*) as n, round(avg(value), 6) as mean_value, quantile_disc(value, 0.95) as p_value from events group by 1",
    "cube_activity": """select o_orderstatus, o_orderpriority, count(*) as orders, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total_minor,
        grouping(o_orderstatus, o_orderpriority) as level from orders group by cube (o_orderstatus, o_orderpriority)""",
    "set_operations": """(select o_custkey, 'finished only' as kind from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O'))
        union all (select o_custkey, 'both' as kind from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'))""",
}
