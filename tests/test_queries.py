"""Every query with SQL gives the same rows as DuckDB at the smallest size."""

from pathlib import Path

import duckdb
import pytest

import compare
from marlstone.queries import banking, checks, corpus, events, relational, workbench
from marlstone.session import TABLES

QUERIES = banking.QUERIES | checks.QUERIES | relational.QUERIES | corpus.QUERIES | workbench.QUERIES | events.QUERIES
SQL = banking.ORACLE_SQL | checks.ORACLE_SQL | relational.ORACLE_SQL | corpus.ORACLE_SQL | workbench.ORACLE_SQL | events.ORACLE_SQL


@pytest.fixture(scope="module")
def db(sf_small):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from read_parquet('{Path(sf_small, t + '.parquet')}')")
    return found


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_small, db, name):
    df = QUERIES[name](spark, sf_small)
    ours = compare.digest(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(SQL[name])
    assert ours == compare.digest([c[0] for c in cursor.description], cursor.fetchall())
