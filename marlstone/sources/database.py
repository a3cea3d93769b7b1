"""Databases behind one boundary: test a connection, read its catalog, run one statement.

SQLite runs here through a Python data source, so its rows come in as a DataFrame, and
directly for statements with a cap and a deadline. Servers are read through Spark's JDBC
source with the same caps; their driver jars are the cluster's to provide.
"""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from marlstone.plans.execute import ROW_CAP, TIMEOUT_S, Result, run_sql
from marlstone.plans.gate import assess, permit
from marlstone.sources.catalog import candidate_engines, jdbc_url, snapshot

#: Operations of SQLite's virtual machine between two looks at the clock.
STEPS = 1000
_AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def _open(path: str, writes: bool = False, timeout_s: float | None = None) -> sqlite3.Connection:
    """A connection to a file that exists, read-only unless `writes`; statements stop at the deadline."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    db = sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode={'rw' if writes else 'ro'}", uri=True, isolation_level=None)
    db.text_factory = lambda raw: raw.decode("utf-8", "replace")
    if timeout_s is not None:
        end = time.monotonic() + timeout_s
        db.set_progress_handler(lambda: int(time.monotonic() > end), STEPS)
    return db


def normal(value: object) -> object:
    """A value as JSON holds it: bytes become a note of their number."""
    return f"<{len(value)} byte blob>" if isinstance(value, bytes) else value


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class SQLite:
    """A SQLite file."""

    path: str
    allow_writes: bool = False

    def test(self) -> None:
        with _open(self.path) as db:
            db.execute("select count(*) from sqlite_master").fetchone()

    def introspect(self) -> list[tuple]:
        """Flat columns (schema, table, kind, position, column, type, nullable, key) in order of
        the tables' names; of a composite key the first column is marked."""
        out = []
        with _open(self.path) as db:
            for name, kind in db.execute("select name, type from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name").fetchall():
                for at, column, type_, required, _, key in db.execute(f"pragma table_info({quoted(name)})"):
                    out.append(("main", name, kind, at, column, type_, not required, "PK" if key == 1 else None))
        return out

    def execute(self, sql: str, confirmed: bool = False, cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S) -> Result:
        """Run one statement that the gate permits; the first `cap` rows. A statement without
        rows returns its operation and how many rows it touched. TimeoutError at the deadline."""
        assessment = assess(sql, "sqlite", self.allow_writes)
        permit(assessment, confirmed)
        began = time.monotonic()
        db = _open(self.path, not assessment.read_only, timeout_s)
        try:
            cursor = db.execute(sql)
            if cursor.description is None:
                return Result(["operation", "affected_rows"], [[assessment.label, max(cursor.rowcount, 0)]], int((time.monotonic() - began) * 1000), False)
            rows = cursor.fetchmany(cap + 1)
            return Result([c[0] for c in cursor.description], [[normal(v) for v in r] for r in rows[:cap]], int((time.monotonic() - began) * 1000), len(rows) > cap)
        except sqlite3.OperationalError as error:
            if "interrupted" in str(error):
                raise TimeoutError(f"the statement took more than {timeout_s:g} seconds") from None
            raise
        finally:
            db.close()

    def full_catalog(self) -> dict:
        """All that the file declares: tables with columns, ordered primary keys, foreign keys
        and indexes, then views and triggers."""
        with _open(self.path) as db:
            made = lambda kind, name: db.execute("select sql from sqlite_master where type = ? and name = ?", (kind, name)).fetchone()
            named = lambda kind: db.execute("select name, tbl_name, sql from sqlite_master where type = ? and name not like 'sqlite_%' order by name", (kind,)).fetchall()
            tables = []
            for name, _, sql in named("table"):
                columns = [{"name": c, "dataType": t, "nullable": not required, "default": default, "primaryKeyOrder": key or None, "hidden": hidden_}
                           for _, c, t, required, default, key, hidden_ in db.execute(f"pragma table_xinfo({quoted(name)})")]
                keys = sorted((c["primaryKeyOrder"], c["name"]) for c in columns if c["primaryKeyOrder"])
                fields = ("id", "sequence", "table", "from", "to", "onUpdate", "onDelete", "match")
                foreign = [dict(zip(fields, r, strict=True)) for r in db.execute(f"pragma foreign_key_list({quoted(name)})")]
                indexes = []
                for _, index, unique, origin, partial in db.execute(f"pragma index_list({quoted(name)})").fetchall():
                    parts = [{"sequence": s, "columnId": i, "name": c, "descending": bool(d), "collation": coll, "key": bool(k)}
                             for s, i, c, d, coll, k in db.execute(f"pragma index_xinfo({quoted(index)})")]
                    found = made("index", index)
                    indexes.append({"name": index, "unique": bool(unique), "origin": origin, "partial": bool(partial), "columns": parts, "sql": found and found[0]})
                tables.append({"name": name, "sql": sql, "columns": columns, "primaryKey": [c for _, c in keys], "foreignKeys": foreign, "indexes": indexes})
            views = [{"name": n, "sql": sql, "columns": [r[1] for r in db.execute(f"pragma table_info({quoted(n)})")]} for n, _, sql in named("view")]
            return {"tables": tables, "views": views, "triggers": [{"name": n, "table": t, "sql": sql} for n, t, sql in named("trigger")]}


@dataclass(frozen=True)
class SparkTables:
    """The session's own tables and views, behind the same boundary."""

    spark: SparkSession
    allow_writes: bool = False

    def test(self) -> None:
        self.spark.sql("select 1").collect()

    def introspect(self) -> list[tuple]:
        """Flat columns (schema, table, kind, position, column, type, nullable, key)."""
        return [tuple(r) for r in snapshot(self.spark).orderBy("schema_name", "table_name", "position").collect()]

    def execute(self, sql: str, confirmed: bool = False, cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S) -> Result:
        return run_sql(self.spark, sql, self.allow_writes, confirmed, cap, timeout_s)


class Database(Protocol):
    """What every engine does: say whether it can be reached, list its columns, run a statement."""

    def test(self) -> None: ...

    def introspect(self) -> list[tuple]: ...

    def execute(self, sql: str, confirmed: bool = False, cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S) -> Result: ...


def detect_engine(port: int, attempt: Callable[[str], object]) -> str:
    """The first engine, the likeliest for the port first, for which `attempt` does not raise.
    ConnectionError with every reason if all fail."""
    failed = []
    for engine in candidate_engines(port):
        try:
            attempt(engine)
            return engine
        except Exception as error:  # noqa: BLE001, a driver may raise anything
            failed.append(f"{engine}: {str(error).splitlines()[0] if str(error) else type(error).__name__}")
    raise ConnectionError("; ".join(failed))


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SQLiteSource(DataSource):
    """`spark.read.format("sqlite")` of a table: options path, dbtable, numPartitions. Tables
    with row ids are read in ranges of them, each by a task of its own; the file has to lie
    where all executors see it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            rows = db.execute(f"pragma table_info({quoted(self.options['dbtable'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['dbtable']}")
        kind = lambda t: next((k for mark, k in _AFFINITY if mark in t.upper()), "string" if not t else "double")
        return ", ".join(f"`{r[1]}` {kind(r[2])}" for r in rows)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["dbtable"], int(options.get("numpartitions", 1)), schema

    def partitions(self) -> Sequence[InputPartition]:
        if self.parts > 1:
            with _open(self.path) as db:
                try:
                    low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a table without row ids, or a view
                    low = None
            if low is not None:
                step = max(1, -(-(high - low + 1) // self.parts))
                return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return [_Range(None, None)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        where, bounds = (" where rowid between ? and ?", (partition.low, partition.high)) if partition.low is not None else ("", ())
        cast = {"bigint": int, "double": float, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v),
                "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        casts = [cast[f.dataType.simpleString()] for f in self.schema.fields]
        with _open(self.path) as db:
            for row in db.execute(f"select {names} from {quoted(self.table)}{where}", bounds):
                yield tuple(None if v is None else c(v) for c, v in zip(casts, row, strict=True))


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 1) -> DataFrame:
    """A table or view of a SQLite file; types follow the declared ones' affinity."""
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", path).option("dbtable", table).option("numPartitions", parts).load()


@dataclass(frozen=True)
class Server:
    """A PostgreSQL, MySQL or SQL Server database, read through Spark's JDBC source."""

    engine: str
    host: str
    port: int
    database: str
    user: str
    tls: str = "prefer"
    timeout_s: int = TIMEOUT_S

    def options(self, password: str) -> dict[str, str]:
        """Options of the JDBC source; user and password are properties, never part of the URL."""
        return {"url": jdbc_url(self.engine, self.host, self.port, self.database, self.tls), "user": self.user, "password": password, "queryTimeout": str(self.timeout_s),
                "fetchsize": "1000"}

    def query(self, spark: SparkSession, sql: str, password: str, cap: int = ROW_CAP) -> DataFrame:
        """At most cap + 1 rows of one statement that the gate takes for a read."""
        dialect = self.engine
        permit(assess(sql, dialect), False)
        reader = spark.read.format("jdbc").options(**self.options(password)).option("query", sql.strip().rstrip(";"))
        return reader.load().limit(cap + 1)


def connection_url(engine: str, user: str, password: str, host: str, port: int, database: str) -> str:
    """A URL with percent-encoded user, password and database, for tools that take one."""
    schemes = {"postgres": "postgresql", "mysql": "mysql", "sqlserver": "sqlserver"}
    jdbc_url(engine, host, port, database)  # checks the host and port
    return f"{schemes[engine]}://{quote(user, safe='')}:{quote(password, safe='')}@{host}:{port}/{quote(database, safe='')}"
