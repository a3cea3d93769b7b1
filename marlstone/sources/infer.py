"""Schemas inferred from source text: SQL DDL, Prisma models and vector collections.

Files are rows (path, body); every file is parsed on its own by an Arrow function that
returns one row per column, and all that concerns several files is done with joins and
windows. Inferred schemas are bounded and never verified against a database.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Limits, names and patterns that decide what is found.
MAX_DEPTH, MAX_ENTRIES, MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES, MAX_TABLES, MAX_COLUMNS, MAX_TYPE = 10, 2000, 1000, 1_000_000, 16_000_000, 500, 100, 80
SKIP_DIRS = (".git", ".svn", "node_modules", "target", "dist", "build", ".next", ".venv", "venv", "vendor", "coverage", "__pycache__", ".idea")
EXTENSIONS = ("sql", "prisma", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs")
CODE = EXTENSIONS[2:]
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml")
SECRETIVE = ("secret", "credential", "password")
CONSTRAINTS = frozenset("CONSTRAINT PRIMARY FOREIGN UNIQUE CHECK KEY INDEX".split())
TYPE_ENDS = frozenset("PRIMARY NOT NULL DEFAULT REFERENCES UNIQUE CHECK CONSTRAINT COLLATE GENERATED IDENTITY AUTO_INCREMENT".split())
PRISMA_TYPES = {"String": "TEXT", "Int": "INTEGER", "BigInt": "BIGINT", "Float": "DOUBLE", "Decimal": "DECIMAL", "Boolean": "BOOLEAN",
                "DateTime": "TIMESTAMP", "Bytes": "BLOB", "Json": "JSON"}
COLLECTION_FIELDS = (("id", "string", False), ("document", "text", True), ("metadata", "object", True), ("embedding", "vector", True), ("uri", "string", True))
COLLECTION_CODE = r"(?i)(?:\bchromadb\b|\blangchain_chroma\b|@langchain/chroma|/vectorstores/chroma|\bChromaClient\b|\bPersistentClient\b)"
COLLECTION_MANIFEST = r"(?i)(?:\bchromadb\b|\blangchain.chroma\b|@langchain/chroma)"
COLLECTION_NAMES = (
    r"""(?i)\b(?:get_or_create_collection|create_collection|get_collection)\s*\(\s*(?:name\s*=\s*)?["']([A-Za-z0-9_.-]{3,80})["']""",
    r"""(?i)\b(?:getOrCreateCollection|createCollection|getCollection)\s*\(\s*\{[^}]{0,500}?\bname\s*:\s*["']([A-Za-z0-9_.-]{3,80})["']""",
    r"""(?i)\b(?:collection_name\s*=|collectionName\s*:)\s*["']([A-Za-z0-9_.-]{3,80})["']""")

SCHEMA = "path string, object int, schema_name string, table_name string, kind string, position int, column_name string, data_type string, nullable boolean, key string"
Column = tuple[str, str, bool, str | None]
Table = tuple[str, str, list[Column]]

_TOKEN = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'[^']*'|\"[^\"]*\"|`[^`]*`|\[[A-Za-z_][\w$]*\]|[A-Za-z_][\w$]*|\s+|.", re.DOTALL)
_QUOTES = "\"`[]"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*", re.ASCII)


def _sql_tokens(body: str) -> list[str]:
    """Tokens of the text; comments have become a space or nothing."""
    found = []
    for token in _TOKEN.findall(body):
        if token.startswith("--"):
            continue
        found.append(" " if token.startswith("/*") or token.isspace() else token)
    return found


def _identifier(token: str) -> str | None:
    bare = token.strip(_QUOTES)
    return bare if _NAME.fullmatch(bare) else None


def _definitions(tokens: list[str], at: int) -> tuple[list[list[str]], int] | None:
    """The comma-separated token lists inside the parenthesis that opens at `at`."""
    parts: list[list[str]] = [[]]
    depth = 0
    for i in range(at, len(tokens)):
        token = tokens[i]
        depth += (token == "(") - (token == ")")
        if depth == 0:
            return parts, i
        if token == "," and depth == 1:
            parts.append([])
        elif i > at:
            parts[-1].append(token)
    return None


def ddl_tables(body: str) -> list[Table]:
    """(schema, table, columns) of the CREATE TABLE statements, in text order. Table
    constraints are left out; a table without readable columns is too."""
    tokens = _sql_tokens(body)
    solid = [i for i, t in enumerate(tokens) if t != " "]
    upper = [tokens[i].upper() for i in solid]
    out: list[Table] = []
    for k in range(len(solid) - 3):
        if upper[k:k + 2] != ["CREATE", "TABLE"]:
            continue
        n = k + 5 if upper[k + 2:k + 5] == ["IF", "NOT", "EXISTS"] else k + 2
        names = []
        while n < len(solid) and (name := _identifier(tokens[solid[n]])):
            names.append(name)
            n += 1
            if n < len(solid) and tokens[solid[n]] == "." and len(names) < 2:
                n += 1
            else:
                break
        if not names or n >= len(solid) or tokens[solid[n]] != "(":
            continue
        found = _definitions(tokens, solid[n])
        if found is None:
            continue
        columns: list[Column] = []
        for part in found[0]:
            while part and part[0] == " ":
                part = part[1:]
            name = _identifier(part[0]) if len(part) > 1 and part[1] == " " else None
            if name is None or name.upper() in CONSTRAINTS:
                continue
            rest = "".join(part[2:])
            kind = " ".join(takewhile(lambda w: w.upper() not in TYPE_ENDS, rest.split()))
            flags = rest.upper()
            if kind and len(kind.encode()) <= MAX_TYPE and len(columns) < MAX_COLUMNS:
                primary = "PRIMARY KEY" in flags
                columns.append((name, kind, "NOT NULL" not in flags and not primary, "PK" if primary else None))
        if columns:
            schema, table = names if len(names) == 2 else ("inferred", names[0])
            out.append((schema, table, columns))
    return out


_MODEL = re.compile(r"^[ \t]*model\s+([A-Za-z_]\w*)\s*\{", re.MULTILINE | re.ASCII)
_FIELD = re.compile(r"([A-Za-z_]\w*)\s+([A-Za-z_]\w*)(\??)", re.ASCII)
_MAPPED = re.compile(r'(?<!@)@map\("([A-Za-z_]\w{0,79})"', re.ASCII)
_TABLE_MAP = re.compile(r'@@map\([^"]*"([A-Za-z_]\w{0,79})"', re.ASCII)


def prisma_tables(body: str) -> list[Table]:
    """(inferred, table, columns) of the models: scalar fields only, names as mapped."""
    out: list[Table] = []
    for model in _MODEL.finditer(body):
        depth, end = 1, model.end()
        while end < len(body) and depth:
            depth += {"{": 1, "}": -1}.get(body[end], 0)
            end += 1
        if depth:
            continue
        name, columns = model[1], []
        for line in map(str.strip, body[model.end():end - 1].splitlines()):
            if line.startswith("@@"):
                if renamed := _TABLE_MAP.match(line):
                    name = renamed[1]
                continue
            field = _FIELD.match(line)
            if field and field[2] in PRISMA_TYPES and len(columns) < MAX_COLUMNS:
                mapped = _MAPPED.search(line)
                columns.append((mapped[1] if mapped else field[1], PRISMA_TYPES[field[2]], bool(field[3]), "PK" if "@id" in line else None))
        if columns:
            out.append(("inferred", name, columns))
    return out


def _rows(path: str, body: str) -> Iterator[tuple]:
    kind = path.rsplit(".", 1)[-1].lower()
    found = ddl_tables(body) if kind == "sql" else prisma_tables(body) if kind == "prisma" else []
    for k, (schema, table, columns) in enumerate(found):
        for position, (name, type_, nullable, key) in enumerate(columns):
            yield path, k, schema, table, "table", position, name, type_, nullable, key


def declared_columns(files: DataFrame) -> DataFrame:
    """One row per column of every table that the files (path, body) declare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        names = [part.strip().split()[0] for part in SCHEMA.split(",")]
        for batch in batches:
            rows = [r for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in _rows(path, body or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return files.select("path", "body").mapInArrow(run, SCHEMA)


def collections(files: DataFrame) -> DataFrame:
    """Vector collections named in code, with their fixed fields, if any file shows that
    the store is used: code with a marker, or a manifest that asks for its package."""
    extension, base = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    marked = files.withColumn("code", extension.isin(*CODE)).withColumn(
        "used", (F.col("code") & F.col("body").rlike(COLLECTION_CODE)) | (base.isin(*MANIFESTS) & F.col("body").rlike(COLLECTION_MANIFEST)))
    used = marked.agg(F.coalesce(F.bool_or("used"), F.lit(False)).alias("any_used"))  # one row
    found = F.concat(*[F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in COLLECTION_NAMES])
    names = marked.filter("code").select("path", F.explode(found).alias("table_name")).groupBy("table_name").agg(F.max("path").alias("path"))
    fields = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.lit(o).alias("nullable"))
                       for i, (n, t, o) in enumerate(COLLECTION_FIELDS)])
    return (names.join(F.broadcast(used)).filter("any_used")
            .select("path", F.lit(0).alias("object"), F.lit("chroma").alias("schema_name"), "table_name", F.lit("collection").alias("kind"), F.explode(fields).alias("f"))
            .select("path", "object", "schema_name", "table_name", "kind", "f.position", "f.column_name", "f.data_type", "f.nullable", F.lit(None).cast("string").alias("key")))


def inferred_schema(files: DataFrame) -> DataFrame:
    """The columns of all tables and collections; of a table that several places declare,
    the one in the last file, and there the last, counts. The first `MAX_TABLES` tables that
    are met, collections after declared ones, are kept."""
    every = declared_columns(files).unionByName(collections(files))
    place = F.struct("path", "object")
    met = F.struct((F.col("kind") == "collection").alias("late"), "path", "object")
    names = ["schema_name", "table_name"]
    known = every.groupBy(*names).agg(F.max(place).alias("_last"), F.min(met).alias("_met")).orderBy("_met", *names).limit(MAX_TABLES).drop("_met")
    return every.join(known, names).filter(place == F.col("_last")).select(*[c for c in every.columns if c != "object"])


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of the files under a folder that may declare schemas, within limits on
    depth, entries, files and bytes. Paths are relative and the limits count in their order.
    Links are not followed in local folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    relative = F.expr(f"substring(path, {len(prefix) + 1})")
    parts, name = F.split("relative", "/"), F.lower(F.element_at(F.split("relative", "/"), -1))
    ok = (~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRS))) & ~name.startswith(".")
          & ~name.rlike("|".join(SECRETIVE)) & (F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*EXTENSIONS) | name.isin(*MANIFESTS)))
    kept = found.select(relative.alias("relative"), "length", "content").filter(F.size(parts) <= MAX_DEPTH + 1).filter(ok & (F.col("length") <= MAX_FILE_BYTES))
    if prefix.startswith("file:"):
        # the driver sees local folders; names are bounded by the number of entries it walks
        top = re.sub("^file:/*", "/", prefix)
        linked = [os.path.relpath(os.path.join(at, n), top) for at, dirs, names in os.walk(top) for n in (*dirs, *names) if os.path.islink(os.path.join(at, n))]
        for link in linked:
            kept = kept.filter((F.col("relative") != link) & ~F.col("relative").startswith(link + "/"))
    order = Window.orderBy("relative")
    sized = kept.select("relative", "length").orderBy("relative").limit(MAX_ENTRIES).withColumn("n", F.row_number().over(order)).withColumn("total", F.sum("length").over(order))
    wanted = sized.filter((F.col("n") <= MAX_FILES) & (F.col("total") <= MAX_TOTAL_BYTES)).select("relative")
    return kept.join(wanted, "relative", "left_semi").select(F.col("relative").alias("path"), F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string").alias("body"))
