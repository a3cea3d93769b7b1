"""Catalogs as data: snapshots of a session, flat and nested forms, and imported exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAT = "schema_name string, table_name string, kind string, position int, column_name string, data_type string, nullable boolean, key string"
EXPORT = ("format string, read_only_requested boolean, captured_at string, transport_verification string, schemas array<string>, "
          "server_information struct<dbms_name:string,dbms_version:string,driver_name:string,driver_version:string>, warnings array<string>, "
          "tables array<struct<schema:string,name:string,kind:string,columns:array<struct<name:string,data_type:string,nullable:boolean,key:string>>>>")
# Limits of an export, and what its system may call itself.
MAX_TABLES, MAX_COLUMNS, MAX_SCHEMAS, MAX_NAME, MAX_TYPE = 500, 2000, 100, 128, 256
IDENTITIES = ("AS/400", "DB2/400", "DB2 FOR I", "ISERIES")


def snapshot(spark: SparkSession, database: str | None = None, primary: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Flat columns of the session's tables and views. Spark has no primary keys, so the
    caller may name them; only the first column of a composite key is marked."""
    rows = []
    for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        schema = (t.namespace or ["session"])[-1]
        full = f"{schema}.{t.name}" if t.namespace else t.name
        key = (primary or {}).get(t.name, ())[:1]
        for i, c in enumerate(spark.catalog.listColumns(full)):
            rows.append((schema, t.name, "view" if "VIEW" in t.tableType or t.isTemporary else "table", i, c.name, c.dataType, c.nullable, "PK" if c.name in key else None))
    return spark.createDataFrame(rows, FLAT)


def nested(flat: DataFrame) -> DataFrame:
    """One row per table with its columns in order."""
    column = F.struct("position", F.col("column_name").alias("name"), "data_type", "nullable", "key")
    ordered = F.array_sort(F.collect_list(column))
    return flat.groupBy("schema_name", "table_name", "kind").agg(F.transform(ordered, lambda c: c.dropFields("position")).alias("columns"))


def keyed_columns(columns: DataFrame, constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """Columns (schema_name, table_name, column_name, ...) with key 'PK' where the table has
    a primary-key constraint that uses the column: an EXISTS over two tables."""
    primary = constraints.filter("constraint_type = 'PRIMARY KEY'").join(usage, ["schema_name", "table_name", "constraint_name"]).select(
        "schema_name", "table_name", "column_name").distinct().withColumn("key", F.lit("PK"))
    return columns.join(primary, ["schema_name", "table_name", "column_name"], "left")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A JSON export with the exact schema; malformed input fails."""
    return spark.read.schema(EXPORT).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def export_errors(exports: DataFrame, format_tag: str) -> list[str]:
    """What is wrong with an imported export: provenance, identity, scope and uniqueness.
    Exports are bounded (500 tables), so the checks' one row is brought to the driver."""
    t = F.col("tables")
    server = [F.coalesce(F.col(f"server_information.{f}"), F.lit("")) != "" for f in ("dbms_name", "dbms_version", "driver_name", "driver_version")]
    named = (F.upper("server_information.dbms_name").rlike("|".join(i.replace("/", "/") for i in IDENTITIES)))
    bad_table = lambda x: (~F.array_contains("schemas", x["schema"]) | (F.length(x["name"]) == 0) | (F.length(x["name"]) > MAX_NAME) | ~x["kind"].isin("table", "view")
                           | (F.size(x["columns"]) == 0) | (F.size(x["columns"]) > MAX_COLUMNS))
    bad_column = lambda c: ((F.length(c["name"]) == 0) | (F.length(c["name"]) > MAX_NAME) | (F.length(c["data_type"]) == 0)
                            | (F.length(c["data_type"]) > MAX_TYPE) | (c["key"].isNotNull() & (c["key"] != "PK")))
    names = F.transform(t, lambda x: F.concat_ws("\u0001", x["schema"], x["name"]))
    repeated = lambda x: F.size(F.array_distinct(F.transform(x["columns"], lambda c: c["name"]))) < F.size(x["columns"])
    checks = {
        "missing or unsupported provenance": ~((F.col("format") == format_tag) & F.col("read_only_requested") & (F.col("transport_verification") == "not-verified-by-exporter")
                                               & F.size("schemas").between(1, MAX_SCHEMAS) & server[0] & server[1] & server[2] & server[3]),
        "unknown database identity": ~named,
        "number of tables": ~F.size(t).between(1, MAX_TABLES),
        "invalid or out-of-scope objects": F.exists(t, bad_table),
        "repeated objects": F.size(F.array_distinct(names)) < F.size(names),
        "invalid or repeated columns": F.exists(t, lambda x: F.exists(x["columns"], bad_column) | repeated(x))}
    row = exports.select("captured_at", *[F.coalesce(c, F.lit(True)).alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    found = [name for i, name in enumerate(checks) if row[f"c{i}"]]
    try:
        if datetime.fromisoformat(row["captured_at"]).tzinfo is None:
            raise ValueError
    except (TypeError, ValueError):
        found.append("capture time")
    return found


def jdbc_url(engine: str, host: str, port: int, database: str, tls: str = "prefer") -> str:
    """A JDBC URL without credentials. Names are percent-encoded and the host's characters
    are checked, so neither can add parameters."""
    from urllib.parse import quote

    if not host or not all(c.isalnum() or c in ".-_:" for c in host):
        raise ValueError("the host has characters that are not allowed")
    if not 0 < port < 65536:
        raise ValueError("the port is out of range")
    name = quote(database, safe="")
    match engine:
        case "postgres":
            return f"jdbc:postgresql://{host}:{port}/{name}?sslmode={tls}"
        case "mysql":
            return f"jdbc:mysql://{host}:{port}/{name}?sslMode={ {'disable': 'DISABLED', 'prefer': 'PREFERRED', 'require': 'REQUIRED'}[tls] }"
        case "sqlserver":
            return f"jdbc:sqlserver://{host}:{port};databaseName={name};encrypt={'false' if tls == 'disable' else 'true'}"
    raise ValueError(f"no JDBC URL for {engine}")


def bounded_read(df: DataFrame, columns: Sequence[str], limit: int, max_bytes: int = 8 * 1024 * 1024) -> tuple[list, bool]:
    """(rows, truncated) of explicit columns: at most `limit` (1 to 10,000) rows and
    `max_bytes` of JSON. ValueError for unknown, repeated or too many columns."""
    import json

    from marlstone.plans.execute import exact

    if not 1 <= len(columns) <= 100 or len(set(columns)) < len(columns) or not set(columns) <= set(df.columns):
        raise ValueError("columns must be known, distinct and 1 to 100")
    if not 1 <= limit <= 10_000:
        raise ValueError("the limit must be between 1 and 10,000")
    rows, size = [], 0
    for row in df.select(*[F.col(f"`{c}`") for c in columns]).limit(limit + 1).toLocalIterator():
        value = [exact(v) for v in row]
        size += len(json.dumps(value, ensure_ascii=False).encode())
        if len(rows) == limit or size > max_bytes:
            return rows, True
        rows.append(value)
    return rows, False


def candidate_engines(port: int) -> list[str]:
    """The engines to probe for a port, the likeliest first."""
    usual = {5432: "postgres", 3306: "mysql", 1433: "sqlserver"}
    every = list(usual.values())
    return sorted(every, key=lambda e: (e != usual.get(port), every.index(e)))


def vector_catalog(path: str, limit: int = 500) -> list[tuple[str, int | None]]:
    """(name, dimension) of the collections in a local vector store's SQLite catalog, opened
    read-only; names that are not 3 to 80 plain characters are left out, and dimensions
    that are not between 1 and a million are None."""
    import re
    import sqlite3
    from pathlib import Path

    with sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True) as db:
        rows = db.execute("select name, dimension from collections order by name limit ?", (limit,)).fetchall()
    fits = lambda d: isinstance(d, int) and 0 < d < 1_000_000
    return [(n, d if fits(d) else None) for n, d in rows if isinstance(n, str) and re.fullmatch(r"[A-Za-z0-9_.-]{3,80}", n)]


def first_difference(actual: object, golden: object, path: str = "$") -> str | None:
    """The path of the first place at which two JSON values differ, None if they are equal."""
    if type(actual) is not type(golden):
        return path
    if isinstance(golden, dict):
        for key in sorted(actual.keys() | golden.keys()):
            if key not in actual or key not in golden:
                return f"{path}.{key}"
            if found := first_difference(actual[key], golden[key], f"{path}.{key}"):
                return found
        return None
    if isinstance(golden, list):
        for i, (a, g) in enumerate(zip(actual, golden, strict=False)):
            if found := first_difference(a, g, f"{path}[{i}]"):
                return found
        return f"{path}[{min(len(actual), len(golden))}]" if len(actual) != len(golden) else None
    return None if actual == golden else path


_SCALED, _SIZED = ("DECIMAL", "NUMERIC"), ("CHAR", "VARCHAR", "NCHAR", "NVARCHAR", "GRAPHIC", "VARGRAPHIC")


def exported(objects: DataFrame, columns: DataFrame, keys: DataFrame | None, schemas: Sequence[str], server: dict[str, str], format_tag: str, captured_at: str) -> dict:
    """An export of the exact schemas from a driver's metadata: objects (schema_name,
    table_name, kind), columns (schema_name, table_name, position, column_name, type_name,
    column_size, decimal_digits, nullable) and primary keys (schema_name, table_name,
    column_name), or None where the driver cannot tell, which is not the same as no keys.

    ValueError for repeated objects, other kinds, too many of anything, or metadata that do
    not say what a column's type is and whether it may be null.
    """
    exact = lambda df: df.filter(F.col("schema_name").isin(*schemas))
    listed = exact(objects).orderBy("schema_name", "table_name").limit(MAX_TABLES + 1).collect()
    if not listed or len(listed) > MAX_TABLES:
        raise ValueError(f"the schemas must hold 1 to {MAX_TABLES} tables and views")
    if len({(r.schema_name, r.table_name) for r in listed}) < len(listed) or any(r.kind.strip().lower() not in ("table", "view") for r in listed):
        raise ValueError("repeated objects, or objects of another kind")
    kind = F.upper("type_name")
    text = (F.when(kind.isin(*_SCALED) & F.col("column_size").isNotNull() & F.col("decimal_digits").isNotNull(), F.format_string("%s(%d,%d)", "type_name", "column_size", "decimal_digits"))
            .when(kind.isin(*_SIZED) & F.col("column_size").isNotNull(), F.format_string("%s(%d)", "type_name", "column_size")).otherwise(F.col("type_name")))
    every = exact(columns).withColumn("data_type", text)
    names = ["schema_name", "table_name", "column_name"]
    marked = every.withColumn("key", F.lit(None).cast("string")) if keys is None else every.join(
        exact(keys).select(*names).distinct().withColumn("key", F.lit("PK")), names, "left")
    column = F.struct("position", F.col("column_name").alias("name"), F.col("data_type").alias("dataType"), "nullable", "key")
    folded = marked.groupBy("schema_name", "table_name").agg(F.array_sort(F.collect_list(column)).alias("columns")).filter(F.size("columns") <= MAX_COLUMNS)
    held = {(r.schema_name, r.table_name): r.columns for r in folded.limit(MAX_TABLES + 1).collect()}
    tables = []
    for r in listed:
        found = held.get((r.schema_name, r.table_name), [])
        if not found or any(c.nullable is None or not c.dataType for c in found):
            raise ValueError(f"the metadata of {r.schema_name}.{r.table_name} are not complete")
        tables.append({"schema": r.schema_name, "name": r.table_name, "kind": r.kind.strip().lower(),
                       "columns": [{"name": c.name, "dataType": c.dataType, "nullable": c.nullable, "key": c.key} for c in found]})
    warnings = [] if keys is not None else ["Primary keys are unknown: the driver does not tell them."]
    return {"format": format_tag, "capturedAt": captured_at, "serverInformation": server, "transportVerification": "not-verified-by-exporter", "readOnlyRequested": True,
            "schemas": list(schemas), "tables": tables, "warnings": warnings}
