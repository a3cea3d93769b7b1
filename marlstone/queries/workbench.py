"""The workbench around SQL: gate, catalogs, inferred schemas, changes, manifests, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.operators import dml, manifest
from marlstone.plans import gate
from marlstone.session import table
from marlstone.sources import catalog, infer, web

#: (name, dialect, writes allowed, statement, what the gate says)
STATEMENTS = [
    ("select", "sqlite", False, "SELECT * FROM accounts", "read"), ("cte", "postgres", False, "WITH a AS (SELECT 1) SELECT * FROM a;", "read"),
    ("explain", "mysql", False, "EXPLAIN SELECT 1", "read"), ("show", "mysql", False, "SHOW TABLES", "read"), ("show on sqlite", "sqlite", False, "SHOW TABLES", "refused"),
    ("pragma", "sqlite", False, "PRAGMA table_info(accounts)", "read"), ("pragma set", "sqlite", False, "PRAGMA foreign_keys = OFF", "refused"),
    ("comment", "sqlite", False, "SELECT 1 -- ; DROP TABLE x", "read"), ("literal", "sqlite", False, "SELECT 'DELETE; FROM x'", "read"),
    ("dollar body", "postgres", False, "SELECT $q$ DROP TABLE x; $q$", "read"), ("stacked", "sqlite", True, "SELECT 1; DROP TABLE accounts", "refused"),
    ("insert", "sqlite", False, "INSERT INTO branches VALUES (99)", "refused"), ("insert allowed", "sqlite", True, "INSERT INTO branches VALUES (99)", "insert"),
    ("update", "sqlite", True, "UPDATE accounts SET status = 'CLOSED'", "update"), ("delete", "sqlite", True, "DELETE FROM customers", "delete"),
    ("cte delete", "postgres", True, "WITH removed AS (DELETE FROM accounts RETURNING account_id) SELECT * FROM removed", "delete"),
    ("merge", "sqlserver", True, "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "merge"), ("create", "sqlite", True, "CREATE TABLE forbidden(id INTEGER)", "ddl"),
    ("select into", "sqlserver", True, "SELECT * INTO copied FROM accounts", "ddl"), ("call", "mysql", True, "CALL refresh()", "procedure"),
    ("grant", "postgres", True, "GRANT SELECT ON t TO u", "permission"), ("vacuum", "postgres", True, "VACUUM", "maintenance"),
    ("row lock", "postgres", True, "SELECT * FROM t FOR UPDATE", "maintenance"), ("transaction", "sqlite", True, "BEGIN TRANSACTION", "refused"),
    ("attach", "sqlite", True, "ATTACH DATABASE 'other' AS other", "refused"), ("outfile", "mysql", True, "SELECT 1 INTO OUTFILE '/x'", "refused"),
    ("host function", "postgres", False, "SELECT pg_read_file('/etc/passwd')", "refused"), ("replace in a read", "sqlite", False, "SELECT replace(a, 'x', 'y') FROM t", "refused"),
    ("unterminated", "sqlite", False, "SELECT 'abc", "refused"), ("empty", "sqlite", False, " ; ", "refused")]


def _outcome(sql: str, dialect: str, writes: bool) -> str:
    try:
        return gate.assess(sql, dialect, writes).operation
    except gate.Refused:
        return "refused"


def gate_classification(spark: SparkSession, d: str) -> DataFrame:
    """What the gate says about statements of several dialects."""
    rows = [(name, dialect, writes, _outcome(sql, dialect, writes)) for name, dialect, writes, sql, _ in STATEMENTS]
    return spark.createDataFrame(rows, "name string, dialect string, writes boolean, outcome string")


#: (statement, what the gate says of it with writes allowed), told from Spark's own plans
SPARK_STATEMENTS = [
    ("select * from gate_orders", "read"), ("with a as (select 1 as x) select x from a", "read"), ("explain select 1", "read"), ("show tables", "read"),
    ("select 'reflect(1)' as x", "read"), ("select (select max(o_orderkey) from gate_orders) as x", "read"),
    ("insert into gate_orders select 1", "insert"), ("update gate_orders set o_orderkey = 1", "update"), ("delete from gate_orders", "delete"),
    ("create table gate_new (a int) using parquet", "ddl"), ("create view gate_new as select 1 as x", "ddl"), ("drop table gate_orders", "ddl"), ("set spark.x = 1", "maintenance"),
    ("select reflect/**/('java.lang.System', 'getProperty', 'user.home')", "refused"), ("select \"'\" as a, reflect('a', 'b') as b, \"'\" as c", "refused"),
    ("select `JAVA_METHOD` ('a', 'b')", "refused"), ("select identifier('reflect')('a', 'b')", "refused"), ("explain select reflect('a', 'b')", "refused"),
    ("create temporary view v using text options (path '/etc/passwd')", "refused"), ("create table v using text options (path '/etc/passwd')", "refused"),
    ("create table v (a int) using parquet location '/x'", "refused"), ("select * from text.`/etc/passwd`", "refused"), ("insert into parquet.`/x` select 1", "refused"),
    ("select transform(o_orderkey) using 'cat' from gate_orders", "refused"), ("execute immediate 'select 1'", "refused"), ("select 1; select 2", "refused")]


def spark_gate(spark: SparkSession, d: str) -> DataFrame:
    """What the gate says about Spark statements, by their parsed plans."""
    rows = []
    for sql, _ in SPARK_STATEMENTS:
        try:
            outcome = gate.assess_spark(spark, sql, allow_writes=True).operation
        except gate.Refused:
            outcome = "refused"
        rows.append((sql, outcome))
    return spark.createDataFrame(rows, "statement string, outcome string")


def gate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Label and flags of every operation."""
    rows = [(a.operation, a.label, a.read_only, a.destructive, a.requires_confirmation) for a in map(gate.Assessment.of, gate.LABELS)]
    return spark.createDataFrame(rows, "operation string, label string, read_only boolean, destructive boolean, requires_confirmation boolean")


FILES = [
    ("db/schema.sql", "-- base\nCREATE TABLE shop.customer (\n id BIGINT PRIMARY KEY, name VARCHAR(80) NOT NULL, balance DECIMAL(10, 2) DEFAULT 0,\n CONSTRAINT u UNIQUE (name)\n);\n"
                      "create table if not exists `orders` (`key` int not null, note text /* free */, FOREIGN KEY (`key`) REFERENCES customer(id));"),
    ("db/zz_override.sql", "CREATE TABLE orders (key BIGINT PRIMARY KEY, total DOUBLE PRECISION);"),
    ("app/schema.prisma", "model User {\n  id Int @id\n  email String? @map(\"mail\")\n  posts Post[]\n  at DateTime\n  @@map(\"app_user\")\n}\n"),
    ("app/store.py", "import chromadb\nc = client.get_or_create_collection(name=\"papers\")\nd = client.get_collection('notes')\n"),
    ("app/readme.md", "CREATE TABLE ignored (a int);")]


def inferred_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns inferred from a small project: SQL, Prisma and vector collections."""
    return infer.inferred_schema(spark.createDataFrame(FILES, "path string, body string")).select(
        "schema_name", "table_name", "kind", "position", "column_name", "data_type", "nullable", F.coalesce("key", F.lit("")).alias("key"), "path")


_PRIMARY = {"nation": ["n_nationkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"]}


def _columns(spark: SparkSession, d: str) -> DataFrame:
    rows = [("main", t, c.name, i) for t in ("nation", "orders", "lineitem", "customer") for i, c in enumerate(table(spark, d, t).schema)]
    return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, position int")


def catalog_pk_exists(spark: SparkSession, d: str) -> DataFrame:
    """Columns of four tables, marked where a primary-key constraint uses them."""
    constraints = spark.createDataFrame([("main", t, f"pk_{t}", "PRIMARY KEY") for t in _PRIMARY] + [("main", "orders", "u_orders", "UNIQUE")],
                                        "schema_name string, table_name string, constraint_name string, constraint_type string")
    usage = spark.createDataFrame([("main", t, f"pk_{t}", c) for t, cs in _PRIMARY.items() for c in cs] + [("main", "orders", "u_orders", "o_custkey")],
                                  "schema_name string, table_name string, constraint_name string, column_name string")
    return catalog.keyed_columns(_columns(spark, d), constraints, usage).select("table_name", "column_name", F.coalesce("key", F.lit("")).alias("key"))


def catalog_nested(spark: SparkSession, d: str) -> DataFrame:
    """The same columns folded into one row a table."""
    flat = _columns(spark, d).withColumns({"kind": F.lit("table"), "data_type": F.lit(""), "nullable": F.lit(True), "key": F.lit("")})
    return catalog.nested(flat).select("table_name", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Orders after every tenth is finished and a few new ones arrive."""
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(
        old.filter("o_orderkey < 5").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return dml.upsert(old, new, ["o_orderkey"])


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Nations after rows are added that partly exist."""
    old = table(spark, d, "nation").select("n_nationkey", "n_name")
    new = old.withColumn("n_nationkey", (F.col("n_nationkey") + 20).cast("int")).withColumn("n_name", F.concat("n_name", F.lit("+")))
    return dml.insert_ignore(old, new, ["n_nationkey"])


def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    """How many orders an update touches, and the statuses after it."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    where = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000)
    touched = dml.affected(old, where, "update").select(F.lit("affected").alias("name"), F.col("affected_rows").alias("n"))
    after = dml.update(old, where, {"o_orderstatus": F.lit("H")}).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return touched.unionByName(after.select(F.col("o_orderstatus").alias("name"), "n"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left per table after the customers of one nation go with all that hangs on them."""
    names = ("customer", "orders", "lineitem")
    left = dml.cascade_delete({t: table(spark, d, t) for t in names}, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")],
                              "customer", F.col("c_nationkey") == 7)
    out = None
    for t in names:
        one = left[t].agg(F.count("*").alias("rows_left")).select(F.lit(t).alias("table_name"), "rows_left")
        out = one if out is None else out.unionByName(one)
    return out


def status_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit rows that changing the status of some orders leaves."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = dml.update(old, F.col("o_orderkey") % 50 == 0, {"o_orderstatus": F.lit("F")})
    return dml.status_audit(old, new, "o_orderkey", "o_orderstatus", "ORDER")


def _resources(spark: SparkSession, d: str) -> DataFrame:
    size = F.char_length("html")
    return table(spark, d, "pages").select(
        "url", F.when(F.col("page_id") % 7 == 0, "failed").otherwise("downloaded").alias("status"), F.when(F.col("page_id") % 5 == 0, "pdf").otherwise("html").alias("kind"),
        F.concat(F.lit("f/"), F.col("page_id") % 40).alias("path"), size.cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"), (F.col("page_id") % 3).cast("string").alias("release"))


def manifest_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a manifest: counts per release."""
    return manifest.collection_statistics(_resources(spark, d), "release")


def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """An older manifest merged with a newer one by url: rows by status."""
    r = _resources(spark, d).groupBy("url").agg(F.min("status").alias("status"))
    old, new = r.filter(~F.col("url").endswith("/")), r.filter(F.col("status") == "downloaded").withColumn("status", F.lit("renewed"))
    return manifest.merge(old, new).groupBy("status").agg(F.count("*").alias("n"))


def manifest_unavailable(spark: SparkSession, d: str) -> DataFrame:
    """Pages that were not downloaded."""
    return manifest.unavailable(_resources(spark, d)).select("url", "status", "path")


def manifest_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Paths per release whose title fits a subject."""
    titled = web.page_check(table(spark, d, "pages"), "page_id").join(table(spark, d, "pages").select("page_id", "url"), "page_id").select(
        (F.col("page_id") % 3).cast("string").alias("release"), F.concat(F.lit("f/"), F.col("page_id") % 40).alias("path"), "title")
    return manifest.coverage(titled, ["0", "1", "2", "3"], {"the": "(?i)the", "umlaut": "[äöü]"}).select("release", "subject", F.array_join("paths", ",").alias("paths"))


def integrity_verify(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose stored size or digest was changed on purpose, with what is found."""
    r = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "utf-8").alias("content"))
    listed = r.select("path", (F.octet_length("content") + F.when(F.col("path").cast("int") % 11 == 0, 1).otherwise(0)).alias("bytes"),
                      F.when(F.col("path").cast("int") % 13 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return manifest.integrity_errors(listed, r.filter(F.col("path").cast("int") % 17 != 0)).select("path", F.array_join("errors", ",").alias("errors"))


def link_reach(spark: SparkSession, d: str) -> DataFrame:
    """Nations within two steps of nation 0, where n leads to 2n and 2n + 1."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    edges = n.select("src", F.explode(F.array(F.col("src") * 2, F.col("src") * 2 + 1)).alias("dst"))
    return manifest.reachable(edges, spark.createDataFrame([(1,)], "node long"), 300, 4).withColumn("depth", F.col("depth").cast("long"))


def git_blob_names(spark: SparkSession, d: str) -> DataFrame:
    """The git blob name of every benchmark item."""
    return table(spark, d, "benchmark").select("item_id", manifest.git_blob(F.encode("text", "utf-8")).alias("blob"))


def history_listing(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest conversations: title, turns and place."""
    c = table(spark, d, "conversations")
    by = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").alias("first_text")).orderBy(F.desc("conv_id")).limit(50)
    place = F.row_number().over(Window.orderBy(F.desc("conv_id")))
    return by.select("conv_id", "turns", T.chat_title(F.col("first_text")).alias("title"), place.cast("long").alias("place"))


def help_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose joined fields hold a text, in any case."""
    joined = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").filter(joined.contains("widget brand#13")).select("p_partkey", "p_name", "p_brand")


QUERIES = {f.__name__: f for f in (
    gate_classification, spark_gate, gate_flags, inferred_columns, catalog_pk_exists, catalog_nested, upsert_merge, insert_ignore, conditional_update, cascade_delete, status_audit,
    manifest_statistics, manifest_merge, manifest_unavailable, manifest_coverage, integrity_verify, link_reach, git_blob_names, history_listing, help_search)}


def _quoted(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _rows(rows: list[tuple], names: str) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) as t({names})"


_INFERRED = [
    ("shop", "customer", "table", 0, "id", "BIGINT", False, "PK", "db/schema.sql"), ("shop", "customer", "table", 1, "name", "VARCHAR(80)", False, "", "db/schema.sql"),
    ("shop", "customer", "table", 2, "balance", "DECIMAL(10, 2)", True, "", "db/schema.sql"),
    ("inferred", "orders", "table", 0, "total", "DOUBLE PRECISION", True, "", "db/zz_override.sql"), ("inferred", "app_user", "table", 0, "id", "INTEGER", False, "PK", "app/schema.prisma"),
    ("inferred", "app_user", "table", 1, "mail", "TEXT", True, "", "app/schema.prisma"), ("inferred", "app_user", "table", 2, "at", "TIMESTAMP", False, "", "app/schema.prisma"),
    *[("chroma", t, "collection", i, n, k, o, "", "app/store.py") for t in ("papers", "notes") for i, (n, k, o) in enumerate(infer.COLLECTION_FIELDS)]]
_FLAGS = [(o, label, o == "read", o in ("delete", "ddl", "procedure", "permission", "maintenance"), o != "read") for o, label in (
    ("read", "Read query"), ("insert", "Insert rows"), ("update", "Update rows"), ("delete", "Delete rows"), ("merge", "Merge or replace rows"), ("ddl", "Schema change"),
    ("procedure", "Procedure execution"), ("permission", "Permission change"), ("maintenance", "Database maintenance"))]
_COLUMNS = "(select table_name, column_name, ordinal_position from information_schema.columns where table_name in ('nation', 'orders', 'lineitem', 'customer'))"
_RES = """(select url, case when page_id % 7 = 0 then 'failed' else 'downloaded' end as status, case when page_id % 5 = 0 then 'pdf' else 'html' end as kind, 'f/' || (page_id % 40) as path,
  length(html) as bytes, sha256(html) as sha256, cast(page_id % 3 as varchar) as release from pages)"""
_TITLE = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ ', ''), ' $', '')"
_TITLED = "regexp_replace(regexp_replace(regexp_replace(arg_min(text, turn), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ ', ''), ' $', '')"

ORACLE_SQL = {
    "gate_classification": _rows([(n, dialect, w, o) for n, dialect, w, _, o in STATEMENTS], "name, dialect, writes, outcome"),
    "spark_gate": _rows(SPARK_STATEMENTS, "statement, outcome"),
    "gate_flags": _rows(_FLAGS, "operation, label, read_only, destructive, requires_confirmation"),
    "inferred_columns": _rows(_INFERRED, "schema_name, table_name, kind, position, column_name, data_type, nullable, key, path"),
    "catalog_pk_exists": f"""select table_name, column_name, case when exists (select 1 from (values {', '.join(f"('{t}', '{c}')" for t, cs in _PRIMARY.items() for c in cs)}) as u(t, c)
        where u.t = table_name and u.c = column_name) then 'PK' else '' end as key from {_COLUMNS}""",
    "catalog_nested": f"select table_name, string_agg(column_name, ',' order by ordinal_position) as columns from {_COLUMNS} group by 1",
    "upsert_merge": """select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders
        union all select -o_orderkey - 1, o_custkey, o_orderstatus from orders where o_orderkey < 5""",
    "insert_ignore": "select n_nationkey, n_name from nation union all select n_nationkey + 20, n_name || '+' from nation where n_nationkey + 20 not in (select n_nationkey from nation)",
    "conditional_update": """select 'affected' as name, count(*) filter (where o_orderstatus = 'O' and o_totalprice > 200000) as n from orders union all
        select case when o_orderstatus = 'O' and o_totalprice > 200000 then 'H' else o_orderstatus end, count(*) from orders group by 1""",
    "cascade_delete": """with c as (select c_custkey from customer where c_nationkey = 7), o as (select o_orderkey from orders where o_custkey in (from c))
        select 'customer' as table_name, count(*) as rows_left from customer where c_nationkey <> 7 union all select 'orders', count(*) from orders where o_custkey not in (from c)
        union all select 'lineitem', count(*) from lineitem where l_orderkey not in (from o)""",
    "status_audit": """select 'ORDER' as entity_type, o_orderkey as entity_id, 'STATUS_CHANGED' as action, '{"new":"F","old":"' || o_orderstatus || '"}' as changes_json from orders
        where o_orderkey % 50 = 0 and o_orderstatus <> 'F'""",
    "manifest_statistics": f"""select release, count(*) as records, count(distinct path) as paths, count(distinct sha256) as hashes, count(*) filter (where kind = 'pdf') as pdfs,
        count(*) filter (where status <> 'downloaded') as unavailable from {_RES} group by 1""",
    "manifest_merge": f"""with r as (select url, min(status) as status from {_RES} group by 1), n as (select url, 'renewed' as status from r where status = 'downloaded'),
        o as (select * from r where not ends_with(url, '/')) select status, count(*) as n from (select * from n union all select * from o where url not in (select url from n)) group by 1""",
    "manifest_unavailable": f"select url, status, path from {_RES} where status <> 'downloaded'",
    "manifest_coverage": f"""with t as (select cast(page_id % 3 as varchar) as release, 'f/' || (page_id % 40) as path, {_TITLE} as title from pages),
        w as (select * from (values ('0'), ('1'), ('2'), ('3')) as r(release), (values ('the', '(?i)the'), ('umlaut', '[äöü]')) as s(subject, p))
        select w.release, subject, coalesce(array_to_string(list_sort(list(distinct path) filter (where path is not null)), ','), '') as paths
        from w left join t on t.release = w.release and regexp_matches(title, p) group by 1, 2""",
    "integrity_verify": """select path, errors from (select cast(page_id as varchar) as path, case when page_id % 17 = 0 then 'missing' else
        concat_ws(',', case when page_id % 11 = 0 then 'bytes' end, case when page_id % 13 = 0 then 'sha256' end) end as errors from pages) where errors <> ''""",
    "link_reach": """with recursive r(node, depth) as (select 1::bigint, 0::bigint union select dst, depth + 1 from r join (select n_nationkey as src, unnest([n_nationkey * 2, n_nationkey * 2 + 1]) as dst
        from nation) on src = node where depth < 4) select node, min(depth) as depth from r group by 1""",
    "git_blob_names": "select item_id, sha1(concat('blob ', strlen(text), chr(0), text)) as blob from benchmark",
    "history_listing": f"""select conv_id, turns, title, row_number() over (order by conv_id desc) as place from (select conv_id, count(*) as turns, substr({_TITLED}, 1, 64) as title
        from conversations group by 1 order by conv_id desc limit 50)""",
    "help_search": "select p_partkey, p_name, p_brand from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'widget brand#13')",
}
