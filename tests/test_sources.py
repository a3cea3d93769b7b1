import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dml, manifest
from marlstone.sources import catalog, fixture, infer

GOLDEN = {m[0]: m[1] for m in re.findall(r"\| `(\w+)` \| `([0-9a-f]{64})` \| `[0-9a-f]{64}` \|", Path(__file__).parent.parent.joinpath("FIXTURES.md").read_text())}


@pytest.fixture(scope="module")
def bank(spark):
    return fixture.build(spark, "small")


@pytest.mark.parametrize("name", sorted(fixture.KEYS))
def test_fixture_digest(bank, name):
    assert fixture.ordered_digest(bank[name], fixture.KEYS[name])[1] == GOLDEN[name]


def test_fixture_invariants(spark, bank):
    assert spark.sql("select transaction_id from ledger_entries group by 1 having sum(amount_minor) <> 0").isEmpty()
    assert spark.table("ledger_entries").count() == 2 * spark.table("ledger_transactions").count()
    assert spark.table("customers").filter("email not like '%@example.invalid'").isEmpty()
    # accounts that are dormant never get entries, so the question about them has no answer
    assert spark.sql("select 1 from accounts a join ledger_entries e using (account_id) where a.status = 'DORMANT' and e.posted_at > a.last_activity_at").isEmpty()
    reversed_ = spark.sql("""select 1 from ledger_transactions r join ledger_transactions o on o.transaction_id = r.reversal_of_id
        where r.amount_minor <> o.amount_minor or r.currency_code <> o.currency_code""")
    assert reversed_.isEmpty()


@pytest.mark.parametrize("view", sorted(fixture.VIEWS))
def test_views_have_rows(spark, bank, view):
    assert spark.table(view).count() > 0


def test_ddl_edges():
    assert infer.ddl_tables("create table t (a numeric(4,2) default (1 + (2)), \"b c\" int, check (a > 0))") == [("inferred", "t", [("a", "numeric(4,2)", True, None)])]
    assert infer.ddl_tables("create table t (a int") == []
    assert infer.ddl_tables("-- create table x (a int)\n/* create table y (a int) */ select 'create table z (a int)'") == []
    assert infer.prisma_tables("model A {\n  b B\n  c C[]\n}") == []


def test_collections_need_a_marker(spark):
    files = lambda body: spark.createDataFrame([("a.py", body)], "path string, body string")
    assert infer.collections(files("x.create_collection('abc')")).isEmpty()
    assert infer.collections(files("import chromadb\nx.create_collection('abc')")).count() == 5


def test_directory_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "a.sql").write_text("create table t (a int);")
    (tmp_path / "node_modules" / "b.sql").write_text("create table u (a int);")
    (tmp_path / "my_secret.sql").write_text("create table v (a int);")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "db" / "link.sql").symlink_to(tmp_path / "my_secret.sql")
    found = infer.inferred_schema(infer.scan_directory(spark, str(tmp_path))).collect()
    assert [(r.path, r.table_name, r.column_name) for r in found] == [("db/a.sql", "t", "a")]


def test_catalog_snapshot_and_reads(spark):
    spark.range(30).withColumn("v", F.col("id") * 2).createOrReplaceTempView("snap_t")
    flat = catalog.snapshot(spark, primary={"snap_t": ["id", "v"]}).filter("table_name = 'snap_t'")
    assert [(r.column_name, r.key) for r in flat.orderBy("position").collect()] == [("id", "PK"), ("v", None)]
    assert catalog.bounded_read(spark.table("snap_t"), ["v"], 3) == ([[0], [2], [4]], True)
    with pytest.raises(ValueError):
        catalog.bounded_read(spark.table("snap_t"), ["nope"], 3)
    assert catalog.jdbc_url("postgres", "db.example", 5432, "a/b?c", "require") == "jdbc:postgresql://db.example:5432/a%2Fb%3Fc?sslmode=require"
    with pytest.raises(ValueError):
        catalog.jdbc_url("mysql", "db?x=1", 3306, "a")


def test_export_checks(spark, tmp_path):
    good = ('{"format": "tag", "read_only_requested": true, "captured_at": "2026-01-01T00:00:00+00:00", "transport_verification": "not-verified-by-exporter", "schemas": ["S"], "warnings": [], '
            '"server_information": {"dbms_name": "DB2/400 SQL", "dbms_version": "7", "driver_name": "d", "driver_version": "1"}, '
            '"tables": [{"schema": "S", "name": "T", "kind": "table", "columns": [{"name": "A", "data_type": "INT", "nullable": false, "key": "PK"}]}]}')
    def errors(text):
        path = tmp_path / f"e{abs(hash(text))}.json"
        path.write_text(text)
        return catalog.export_errors(catalog.read_export(spark, str(path)), "tag")

    assert errors(good) == []
    assert errors(good.replace("DB2/400 SQL", "Other")) == ["unknown database identity"]
    assert errors(good.replace('"schema": "S"', '"schema": "X"')) == ["invalid or out-of-scope objects"]
    assert errors(good.replace("+00:00", "")) == ["capture time"]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    n = spark.createDataFrame([(2, "b"), (3, None)], "k int, v string")
    assert sorted(dml.upsert(t, n, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(dml.Immutable):
        dml.delete(t, F.col("k") == 1, immutable=True)
    assert dml.delete(t, F.col("v") == "a").count() == 1
    assert dml.insert_ignore(t, n, ["k"]).count() == 3


def test_reachable_handles_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "src long, dst long")
    found = {r.node: r.depth for r in manifest.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert found == {1: 0, 2: 1, 3: 2}


def test_tables_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(infer, "MAX_TABLES", 2)
    files = [("a.sql", "create table x (a int); create table y (a int);"), ("b.sql", "create table z (a int); create table x (b int);")]
    got = infer.inferred_schema(spark.createDataFrame(files, "path string, body string")).collect()
    assert sorted((r.table_name, r.column_name) for r in got) == [("x", "b"), ("y", "a")]
