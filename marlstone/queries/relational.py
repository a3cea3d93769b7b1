"""Joins, windows, groupings and scalar functions that statements may use, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import dml, ledger, manifest
from marlstone.operators.ranges import percentiles as percentiles_of
from marlstone.operators.ranges import running_total
from marlstone.session import table


def full_join_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their lines of two halves, full outer: how many match or stand alone."""
    orders = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", F.lit(1).alias("has_order"))
    lines = table(spark, d, "lineitem").filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return orders.join(lines, "o_orderkey", "full").groupBy(F.col("has_order").isNotNull().alias("in_orders"), F.col("lines").isNotNull().alias("in_lines")).agg(
        F.count("*").alias("n_keys"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"))


def right_join_nations(spark: SparkSession, d: str) -> DataFrame:
    """All nations with their customers of one segment, right outer."""
    some = table(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD' and c_acctbal > 9000")
    return some.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


def cross_join_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every region with every market segment, and the customers of both. The two sides of
    the cross join are distinct values of small columns."""
    segments = table(spark, d, "customer").select("c_mktsegment").distinct()
    placed = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_regionkey").alias("r_regionkey"), "c_mktsegment").agg(F.count("*").alias("customers"))
    return table(spark, d, "region").select("r_regionkey", "r_name").crossJoin(segments).join(placed, ["r_regionkey", "c_mktsegment"], "left").select(
        "r_name", "c_mktsegment", F.coalesce("customers", F.lit(0)).alias("customers"))


def lateral_join(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with the totals of their own orders, by a lateral subquery."""
    table(spark, d, "customer").createOrReplaceTempView("lateral_customer")
    table(spark, d, "orders").createOrReplaceTempView("lateral_orders")
    return spark.sql("""select c_custkey, n_orders, largest from lateral_customer,
        lateral (select count(*) as n_orders, max(o_totalprice) as largest from lateral_orders where o_custkey = c_custkey)""")


_BANDS = ((0, 50_000, "small"), (50_000, 150_000, "medium"), (150_000, 10_000_000, "large"))


def theta_join_bands(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the price band that holds them, a join on inequalities with a fixed table."""
    bands = spark.createDataFrame(list(_BANDS), "low long, high long, band string")
    price = F.col("o_totalprice")
    return table(spark, d, "orders").join(F.broadcast(bands), (price >= F.col("low")) & (price < F.col("high"))).groupBy("band", "o_orderstatus").agg(F.count("*").alias("orders"))


def window_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames and ranks over the orders of a customer, by a named window and frames of its order."""
    table(spark, d, "orders").createOrReplaceTempView("frame_orders")
    rows = lambda frame: f"(partition by o_custkey order by o_orderdate, o_orderkey rows between {frame})"
    return spark.sql(f"""select o_orderkey, ntile(4) over w as quarter, dense_rank() over w as place, round(percent_rank() over w, 9) as share, round(cume_dist() over w, 9) as upto,
        first_value(o_orderkey) over w as first_key, last_value(o_orderkey) over {rows('current row and unbounded following')} as last_key,
        nth_value(o_orderkey, 2) over {rows('unbounded preceding and unbounded following')} as second_key,
        count(*) over {rows('1 preceding and 1 following')} as near, lead(o_orderkey, 2, -1) over w as after_next
        from frame_orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")


def rollup_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and user group with subtotals along the hierarchy."""
    return table(spark, d, "events").withColumn("band", F.col("user_id") % 10).rollup("event_type", "band").agg(
        F.count("*").alias("events"), F.grouping_id("event_type", "band").alias("level"))


def grouping_sets_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language, by source, and in all."""
    table(spark, d, "documents").createOrReplaceTempView("sets_documents")
    return spark.sql("select lang, source, count(*) as documents, cast(sum(n_chars) as bigint) as chars from sets_documents group by grouping sets ((lang), (source), ())")


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of prices by flag."""
    found = percentiles_of(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q90")])


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct parts per flag, exactly, and whether the sketch's estimate is within a tenth."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("guess")).select(
        "l_returnflag", "parts", (F.abs(F.col("guess") - F.col("parts")) <= 0.1 * F.col("parts")).alias("close"))


def offset_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of twenty of the dearest orders."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


def mixed_sort(spark: SparkSession, d: str) -> DataFrame:
    """Customers by segment ascending, balance descending and key, the first fifty with their places."""
    order = [F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey")]
    best = table(spark, d, "customer").orderBy(*order).limit(50)
    return best.select("c_custkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


def like_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Parts by LIKE, NOT LIKE and ILIKE with both wildcards."""
    name = F.col("p_name")
    return table(spark, d, "part").agg(F.count_if(name.like("s%")).alias("starts"), F.count_if(~name.like("%ring")).alias("other_end"), F.count_if(name.like("_mall%")).alias("one_any"),
                                       F.count_if(name.ilike("%WIDGET%")).alias("any_case"))


def string_functions(spark: SparkSession, d: str) -> DataFrame:
    """Substrings from both ends, positions, lengths and joined text of customers."""
    n = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", F.expr("substr(c_name, -4)").alias("last_four"), F.instr(n, "#").cast("long").alias("mark"), F.expr("substr(c_name, 10, 3)").alias("inner_part"),
        F.concat(F.upper(n), F.lit("/"), F.trim(F.concat(F.lit("  "), F.lower("c_mktsegment")))).alias("joined"), F.char_length(n).cast("long").alias("size"),
        F.lpad((F.col("c_custkey") % 1000).cast("string"), 6, "0").alias("padded"))


def date_text(spark: SparkSession, d: str) -> DataFrame:
    """The time stamps of orders as text with a zone mark."""
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


def json_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of the events' JSON, one row each, counted by key and value."""
    each = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string, string>")).alias("member", "content"))
    return each.groupBy("member", "content").agg(F.count("*").alias("n"))


def json_array_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose JSON array of labels holds one of two values."""
    labels = F.to_json(F.array("lang", "source", F.when(F.col("n_chars") > 3000, "long").otherwise("short")))
    held = F.from_json("labels", "array<string>")
    return table(spark, d, "documents").select("doc_id", labels.alias("labels")).filter(F.arrays_overlap(held, F.array(F.lit("long"), F.lit("src1")))).select("doc_id", "labels")


def touch_timestamp(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose status is updated, with the time of the touch; others keep theirs."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("2020-01-01T00:00:00Z").alias("updated_at"))
    return dml.touched(old, F.col("o_orderkey") % 25 == 0, {"o_orderstatus": F.lit("H")}, "updated_at", F.lit("2024-05-06T07:08:09Z"))


def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """What an insert-or-ignore and a create-as-select report: operation and rows."""
    old = table(spark, d, "nation").select("n_nationkey", "n_name")
    new = old.withColumn("n_nationkey", (F.col("n_nationkey") + 20).cast("int"))
    return dml.inserted(old, new, ["n_nationkey"], "insert").unionByName(dml.inserted(old.limit(0), old.filter("n_nationkey < 7"), ["n_nationkey"], "create"))


def gateway_counters(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: total, failed and seconds by type."""
    return ledger.request_counters(table(spark, d, "events"), ["event_type"], F.col("value") >= 50, F.col("value") / 1000)


def request_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Mean, nearest-rank percentile and events a second of the time that they span, by type."""
    return ledger.throughput(table(spark, d, "events"), ["event_type"], "value", "ts")


def hash_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct contents of several collections together."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.lit("documents").alias("collection"))
    items = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("sha256"), F.lit("benchmark").alias("collection"))
    pages = table(spark, d, "pages").select(F.sha2("html", 256).alias("sha256"), F.lit("pages").alias("collection"))
    return manifest.union_statistics(docs.unionByName(items).unionByName(pages), "collection")


def sorted_output(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts by their digest, each with its place in the stable order of ids."""
    ids = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("id")).distinct()
    return running_total(ids, "id", F.lit(1).cast("long"), "place").orderBy("id")


QUERIES = {f.__name__: f for f in (
    full_join_keys, right_join_nations, cross_join_grid, lateral_join, theta_join_bands, window_frames, rollup_activity, grouping_sets_documents, percentiles, approx_distinct,
    offset_page, mixed_sort, like_patterns, string_functions, date_text, json_members, json_array_filter, touch_timestamp, inserted_rows, gateway_counters, request_throughput,
    hash_union, sorted_output)}

ORACLE_SQL = {
    "full_join_keys": """with o as (select o_orderkey as k from orders where o_orderkey % 3 <> 0), l as (select l_orderkey as k, count(*) as lines from lineitem where l_orderkey % 2 = 0 group by 1)
        select o.k is not null as in_orders, l.k is not null as in_lines, count(*) as n_keys, cast(coalesce(sum(lines), 0) as bigint) as n_lines from o full join l on o.k = l.k group by 1, 2""",
    "right_join_nations": """select n_name, count(c_custkey) as customers from (select * from customer where c_mktsegment = 'HOUSEHOLD' and c_acctbal > 9000)
        right join nation on c_nationkey = n_nationkey group by 1""",
    "cross_join_grid": """select r_name, s.c_mktsegment, (select count(*) from customer c join nation on c_nationkey = n_nationkey
        where n_regionkey = r_regionkey and c.c_mktsegment = s.c_mktsegment) as customers from region cross join (select distinct c_mktsegment from customer) s""",
    "lateral_join": "select c_custkey, count(o_orderkey) as n_orders, max(o_totalprice) as largest from customer left join orders on o_custkey = c_custkey group by 1",
    "theta_join_bands": f"""select band, o_orderstatus, count(*) as orders from orders join (values {', '.join(map(str, _BANDS))}) as b(low, high, band)
        on o_totalprice >= low and o_totalprice < high group by 1, 2""",
    "window_frames": """select o_orderkey, cast(ntile(4) over w as int) as quarter, cast(dense_rank() over w as int) as place, round(percent_rank() over w, 9) as share, round(cume_dist() over w, 9) as upto,
        first_value(o_orderkey) over w as first_key, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between current row and unbounded following) as last_key,
        nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second_key,
        count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 1 preceding and 1 following) as near, lead(o_orderkey, 2, -1) over w as after_next
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "rollup_activity": """select event_type, band, count(*) as events, grouping(event_type, band) as level from (select event_type, user_id % 10 as band from events)
        group by rollup (event_type, band)""",
    "grouping_sets_documents": "select lang, source, count(*) as documents, cast(sum(n_chars) as bigint) as chars from documents group by grouping sets ((lang), (source), ())",
    "percentiles": """select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) as q25, round(quantile_cont(l_extendedprice, 0.5), 6) as q50,
        round(quantile_cont(l_extendedprice, 0.9), 6) as q90 from lineitem group by 1""",
    "approx_distinct": "select l_returnflag, count(distinct l_partkey) as parts, true as close from lineitem group by 1",
    "offset_page": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40",
    "mixed_sort": """select c_custkey, row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) as place from customer
        qualify place <= 50""",
    "like_patterns": """select count(*) filter (where p_name like 's%') as starts, count(*) filter (where p_name not like '%ring') as other_end,
        count(*) filter (where p_name like '_mall%') as one_any, count(*) filter (where p_name ilike '%WIDGET%') as any_case from part""",
    "string_functions": """select c_custkey, substr(c_name, -4) as last_four, instr(c_name, '#') as mark, substr(c_name, 10, 3) as inner_part,
        upper(c_name) || '/' || trim('  ' || lower(c_mktsegment)) as joined, length(c_name) as size, lpad(cast(c_custkey % 1000 as varchar), 6, '0') as padded from customer""",
    "date_text": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as at from orders",
    "json_members": """select member, content, count(*) as n from (select unnest(json_keys(props)) as member, props from events) m,
        lateral (select json_extract_string(props, '$.' || member) as content) group by 1, 2""",
    "json_array_filter": """select doc_id, '["' || lang || '","' || source || '","' || kind || '"]' as labels from (select *, case when n_chars > 3000 then 'long' else 'short' end as kind from documents)
        where kind = 'long' or source = 'src1' or lang in ('long', 'src1')""",
    "touch_timestamp": """select o_orderkey, case when o_orderkey % 25 = 0 then 'H' else o_orderstatus end as o_orderstatus,
        case when o_orderkey % 25 = 0 then '2024-05-06T07:08:09Z' else '2020-01-01T00:00:00Z' end as updated_at from orders""",
    "inserted_rows": """select 'insert' as operation, count(*) as affected_rows from nation where n_nationkey + 20 not in (select n_nationkey from nation)
        union all select 'create', count(*) from nation where n_nationkey < 7""",
    "gateway_counters": """select event_type, count(*) as total, count(*) filter (where value >= 50) as failed, round(sum(value / 1000), 6) as seconds from events group by 1""",
    "request_throughput": """select event_type, count(*) as n, round(avg(value), 6) as mean_value, quantile_disc(value, 0.95) as p_value,
        round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000, 9) as per_second from events group by 1""",
    "hash_union": """with h as (select sha256(text) as s, 'documents' as c from documents union all select sha256(text), 'benchmark' from benchmark union all select sha256(html), 'pages' from pages)
        select c as collection, count(*) as records, count(distinct s) as hashes from h group by 1 union all select 'all', count(*), count(distinct s) from h""",
    "sorted_output": "select id, row_number() over (order by id) as place from (select distinct sha256(text) as id from benchmark)",
}
