import decimal

import pytest

from marlstone.plans.execute import exact, fetch, run_sql
from marlstone.plans.gate import Refused, assess, assess_spark, lex
from marlstone.queries.workbench import STATEMENTS


@pytest.mark.parametrize(("name", "dialect", "writes", "sql", "outcome"), STATEMENTS, ids=[s[0] for s in STATEMENTS])
def test_statements(name, dialect, writes, sql, outcome):
    if outcome == "refused":
        with pytest.raises(Refused):
            assess(sql, dialect, writes)
    else:
        found = assess(sql, dialect, writes)
        assert found.operation == outcome
        assert found.requires_confirmation == (outcome != "read")


def test_lexer_drops_comments_and_quotes():
    assert lex("select a--x;\n, 'it''s; x' /* ; */ from [t;] # y ;\n") == ["SELECT", "A", "FROM"]
    assert lex("select # from ;", "spark") == ["SELECT", "FROM", ";"]
    assert lex("do $x$ drop; $x$ = 1") == ["DO", "="]


@pytest.mark.parametrize(("sql", "outcome"), [
    ("select * from gate_t", "read"), ("with a as (select 1 x) select x from a", "read"), ("explain select 1", "read"), ("show tables", "read"),
    ("insert into gate_t select 1", "insert"), ("update gate_t set id = 1", "update"), ("delete from gate_t", "delete"),
    ("merge into gate_t using gate_t s on gate_t.id = s.id when matched then delete", "merge"), ("create table x (a int) using parquet", "ddl"),
    ("drop table gate_t", "ddl"), ("set spark.x = 1", "maintenance")])
def test_spark_operations(spark, sql, outcome):
    assert assess_spark(spark, sql, allow_writes=True).operation == outcome
    if outcome != "read":
        with pytest.raises(Refused):
            assess_spark(spark, sql)


@pytest.mark.parametrize("sql", [
    "select 'reflect(1)' as x", "select id as reflect from gate_t -- reflect('a')", "with path as (select 1 as location) select location from path", "select sum(id) over path from gate_t window path as (order by id)",
    "explain extended select id from gate_t", "select * from (values (1, 'a')) as t(path, url)", "select explode(array(1, 2))", "select * from default.gate_x", "show columns in gate_t",
    "describe gate_t", "select * from range(3)", "select * from gate_t lateral view explode(array(id)) e as x", "select id in (select 1) from gate_t", "select * from gate_t tablesample (10 percent)"])
def test_spark_reads(spark, sql):
    assert assess_spark(spark, sql).operation == "read"


@pytest.mark.parametrize("sql", [
    "select * from parquet.`/tmp/x`", "select (select max(id) from csv.`/x`)", "select reflect('java.lang.Math', 'random')", "select `java_method`('a', 'b')",
    "select transform(id) using 'cat' from gate_t", "execute immediate 'select 1'", "load data inpath '/x' into table t", "add jar '/x'",
    "insert overwrite directory '/x' select 1", "begin select 1; end", "select 1; select 2", "", "grant select on t to u",
    "select reflect/**/('java.lang.System','getProperty','user.home')", "select \"'\" as a, reflect('java.lang.System','getProperty','x') as b, \"'\" as c",
    "select ReFlEcT\n('a', 'b')", "select `reflect` ('a', 'b')", "select system.builtin.reflect('a', 'b')", "select * from gate_t where (select max(java_method('a', 'b')) from gate_t) is null",
    "with a as (select try_reflect('a', 'b') as x) select x from a", "select 1 order by reflect('a', 'b')", "select count(*) filter (where reflect('a', 'b') = '') over () from gate_t",
    "select * from gate_t a join gate_t b on a.id = reflect('a', 'b')", "select identifier('reflect')('a', 'b')", "select * from identifier('gate_t')",
    "explain select reflect('a', 'b')", "explain insert into parquet.`/x` select 1", "describe query select reflect('a', 'b')", "values (reflect('a', 'b'))",
    "create temporary view v as select reflect('a', 'b') as x", "create table v using parquet as select reflect('a', 'b') as x",
    "create temporary view v using text options (path '/etc/passwd')", "create table v using text options (path '/etc/passwd')", "create table v (a int) using parquet location '/x'",
    "create table v (a int) using csv options ('PATH' = '/x')", "create table v using jdbc options (url 'jdbc:x', dbtable 'y')", "create schema s location '/x'",
    "insert into parquet.`/x` select 1", "select * from Text.`/etc/passwd`", "select * from `org.apache.spark.sql.parquet`.`/x`", "select * from gate_t with (path '/x')",
    "update parquet.`/x` set a = 1", "delete from json.`/x`", "drop table csv.`/x`", "create function f as 'x.Y' using jar '/x'", "alter table gate_t set location '/x'",
    "create table x like gate_t location '/x'", "analyze table gate_t compute statistics; select 1", "refresh '/x'"])
def test_spark_refusals(spark, sql):
    with pytest.raises(Refused):
        assess_spark(spark, sql, allow_writes=True)


def test_result_is_capped_and_exact(spark):
    spark.range(11).createOrReplaceTempView("gate_t")
    r = run_sql(spark, "select id from gate_t order by id;", cap=10)
    assert (len(r.rows), r.truncated, r.columns) == (10, True, ["id"])
    assert not run_sql(spark, "select id from gate_t", cap=11).truncated
    assert run_sql(spark, "select id, 1 as one from gate_t where id < 0").columns == ["id", "one"]
    with pytest.raises(Refused):
        run_sql(spark, "set spark.sql.x = 1", allow_writes=True)
    with pytest.raises(TimeoutError):
        fetch(spark.sql("select count(*) from range(100000000) a join range(100000) b on hash(a.id) % 3 = hash(b.id) % 3"), timeout_s=2)


def test_exact_values():
    assert exact(2**53) == str(2**53)
    assert exact(decimal.Decimal("1.10")) == "1.10"
    assert exact(b"\x00") == {"encoding": "base64", "data": "AA=="}
    with pytest.raises(ValueError):
        exact(float("nan"))
    with pytest.raises(TypeError):
        exact(object())
