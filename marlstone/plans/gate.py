"""The SQL gate: what a single statement does, and whether it may run.

Two layers. `assess` reads any dialect's text with a lexer and classifies it; it needs no
session. `assess_spark` is authoritative for statements that run here: it takes Spark's
own parse of the text and walks all that the plan holds, so side channels that look like a
plain projection (path tables, reflection, TRANSFORM, options) are seen as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

DIALECTS = ("sqlite", "postgres", "mysql", "sqlserver", "spark")

# Words, labels and messages that the behaviour depends on.
FORBIDDEN_IN_READS = frozenset(
    "INSERT UPDATE DELETE MERGE UPSERT REPLACE CREATE ALTER DROP TRUNCATE GRANT REVOKE CALL EXEC EXECUTE BEGIN COMMIT ROLLBACK "
    "SAVEPOINT SET ATTACH DETACH VACUUM ANALYZE INTO COPY LOAD DO HANDLER".split())
EXTERNAL = frozenset(
    "ATTACH DETACH COPY LOAD LOAD_EXTENSION PG_READ_FILE PG_READ_BINARY_FILE PG_STAT_FILE PG_LS_DIR PG_WRITE_FILE "
    "PG_WRITE_BINARY_FILE LO_IMPORT LO_EXPORT DBLINK_EXEC XP_CMDSHELL OPENROWSET OPENDATASOURCE LOAD_FILE".split())
READ_PRAGMAS = frozenset(
    "TABLE_INFO TABLE_XINFO INDEX_LIST INDEX_INFO INDEX_XINFO DATABASE_LIST COMPILE_OPTIONS FOREIGN_KEY_LIST".split())
TRANSACTIONS = frozenset("BEGIN COMMIT ROLLBACK SAVEPOINT".split())
LABELS = {
    "read": "Read query", "insert": "Insert rows", "update": "Update rows", "delete": "Delete rows", "merge": "Merge or replace rows",
    "ddl": "Schema change", "procedure": "Procedure execution", "permission": "Permission change", "maintenance": "Database maintenance"}
DESTRUCTIVE = frozenset("delete ddl procedure permission maintenance".split())
FIRST_WORDS = {
    "merge": frozenset("MERGE UPSERT REPLACE".split()), "ddl": frozenset("CREATE ALTER DROP TRUNCATE".split()),
    "procedure": frozenset("CALL EXEC EXECUTE DO".split()), "permission": frozenset("GRANT REVOKE".split()),
    "maintenance": frozenset("VACUUM ANALYZE SET PRAGMA".split())}


class Refused(ValueError):
    """The statement may not run; the message says why."""


@dataclass(frozen=True)
class Assessment:
    operation: str
    label: str
    read_only: bool
    destructive: bool
    requires_confirmation: bool

    @staticmethod
    def of(operation: str) -> Assessment:
        read = operation == "read"
        return Assessment(operation, LABELS[operation], read, operation in DESTRUCTIVE, not read)


_OPENERS = {"'": "'", '"': '"', "`": "`", "[": "]"}
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")
_DOLLAR = re.compile(r"\$[A-Za-z0-9_]*\$")


def lex(sql: str, dialect: str = "sqlite") -> list[str]:
    """Upper-case words, ';' and '=' outside comments, quoted runs and dollar bodies.

    '#' starts a comment except in Spark, which has no such comment: text behind it is
    inspected there. In Spark '[' does not quote either.
    """
    spark = dialect == "spark"
    out: list[str] = []
    at, size = 0, len(sql)
    while at < size:
        char = sql[at]
        if sql.startswith("--", at) or (char == "#" and not spark):
            end = sql.find("\n", at)
            at = size if end < 0 else end
        elif sql.startswith("/*", at):
            end = sql.find("*/", at + 2)
            if end < 0:
                raise Refused("Unterminated SQL comment.")
            at = end + 2
        elif char in _OPENERS and not (spark and char == "["):
            close = _OPENERS[char]
            end = at + 1
            while True:
                end = sql.find(close, end)
                if end < 0:
                    raise Refused("Unterminated quoted SQL value or identifier.")
                if sql.startswith(close, end + 1):
                    end += 2
                    continue
                break
            at = end + 1
        elif char == "$" and (tag := _DOLLAR.match(sql, at)):
            end = sql.find(tag[0], tag.end())
            if end < 0:
                raise Refused("Unterminated PostgreSQL dollar-quoted body.")
            at = end + len(tag[0])
        elif word := _WORD.match(sql, at):
            out.append(word[0].upper())
            at = word.end()
        else:
            if char in ";=":
                out.append(char)
            at += 1
    return out


def _single(tokens: list[str]) -> list[str]:
    words = [t for t in tokens if t != ";"]
    if not words:
        raise Refused("Enter a SQL statement first.")
    if ";" in tokens[:-1]:
        raise Refused("Only one statement is allowed.")
    return words


def _locks(words: list[str]) -> bool:
    if "LOCK" in words:
        return True
    behind = words[words.index("FOR") + 1:] if "FOR" in words else []
    return "UPDATE" in behind or "SHARE" in behind


def _reads(words: list[str], dialect: str) -> bool:
    if not FORBIDDEN_IN_READS.isdisjoint(words):
        return False
    match words[0]:
        case "SELECT":
            return not _locks(words)
        case "WITH":
            return "SELECT" in words and not _locks(words)
        case "EXPLAIN":
            return not {"SELECT", "WITH"}.isdisjoint(words[1:]) and not _locks(words)
        case "SHOW" | "DESCRIBE" | "DESC":
            return dialect != "sqlite"
        case "PRAGMA":
            return dialect == "sqlite" and len(words) > 1 and words[1] in READ_PRAGMAS and "=" not in words
    return False


def _elevated(words: list[str]) -> str | None:
    first, all_ = words[0], set(words)
    for verb in ("INSERT", "UPDATE", "DELETE"):
        if first == verb or (first == "WITH" and verb in all_):
            return verb.lower()
    for operation, starts in FIRST_WORDS.items():
        if first in starts:
            return operation
    if first == "SELECT" and "INTO" in all_:
        return "ddl"
    return "maintenance" if _locks(words) else None


def assess(sql: str, dialect: str = "sqlite", allow_writes: bool = False) -> Assessment:
    """Classify one statement; Refused if it may not run under the profile's policy."""
    words = _single(lex(sql, dialect))
    pairs = set(zip(words, words[1:], strict=False))
    if not EXTERNAL.isdisjoint(words) or ("INTO", "OUTFILE") in pairs or ("INTO", "DUMPFILE") in pairs:
        raise Refused("External file, database attachment, extension loading, and host-command operations remain blocked.")
    if _reads(words, dialect):
        return Assessment.of("read")
    if not allow_writes:
        raise Refused("This connection is read-only; data and schema changes must be enabled for it first.")
    if not TRANSACTIONS.isdisjoint(words):
        raise Refused("Manual transaction control is not supported: each approved statement runs on its own.")
    operation = _elevated(words)
    if operation is None:
        raise Refused("The statement type is not recognized and remains blocked.")
    return Assessment.of(operation)


# Spark's plan nodes by what they do; anything that is not listed is refused.
_SPARK_OPERATIONS = {
    "read": "Project Filter Aggregate Distinct Sort GlobalLimit LocalLimit Offset Union Intersect Except Join SubqueryAlias UnresolvedRelation "
            "UnresolvedWith WithCTE UnresolvedInlineTable UnresolvedHaving UnresolvedSubqueryColumnAliases OneRowRelation LocalRelation "
            "Generate Expand Window WithWindowDefinition Pivot Unpivot LateralJoin Sample UnresolvedTableValuedFunction UnresolvedHint "
            "UnresolvedTableValuedFunctionAlias UnresolvedTVFAliases ExplainCommand ShowTables ShowTablesCommand ShowColumns ShowNamespaces "
            "ShowCatalogs ShowFunctions ShowViews ShowCreateTable ShowTableProperties ShowPartitions DescribeRelation DescribeColumn "
            "DescribeFunction DescribeNamespace DescribeQueryCommand ResolvedInlineTable UnresolvedNamespace UnresolvedTable "
            "UnresolvedTableOrView UnresolvedFunctionName CurrentNamespace UnresolvedOrderByOrdinal UnresolvedPivot Range Deduplicate Tail "
            "UnresolvedIdentifier UnresolvedProcedure UnresolvedPartitionSpec ResolvedIdentifier",
    "insert": "InsertIntoStatement AppendData OverwriteByExpression", "update": "UpdateTable", "delete": "DeleteFromTable", "merge": "MergeIntoTable",
    "ddl": "CreateTable CreateTableAsSelect ReplaceTable ReplaceTableAsSelect DropTable DropView TruncateTable TruncatePartition CreateViewCommand "
           "CreateView AlterViewAs CreateNamespace DropNamespace RenameTable AddColumns DropColumns RenameColumn AlterColumns ReplaceColumns "
           "SetTableProperties UnsetTableProperties DropTempViewCommand",
    "procedure": "Call", "maintenance": "SetCommand ResetCommand AnalyzeTable AnalyzeColumn AnalyzeTables CacheTable UncacheTable CacheTableAsSelect RefreshTable"}
_SPARK_KIND = {node: op for op, nodes in _SPARK_OPERATIONS.items() for node in nodes.split()}
_HOST_FUNCTIONS = frozenset("reflect java_method try_reflect".split())
#: Keys of options and properties that name a place outside the catalog.
_PLACES = frozenset("path paths location url dbtable".split())
#: First parts of a two-part table name that are no schema of the current catalog.
_ALWAYS_THERE = frozenset("session system global_temp spark_catalog builtin".split())
_MOST_PARTS = 100_000


def _parts(spark: SparkSession, plan) -> Iterator[tuple[str, object, bool]]:
    """(class name, object, whether it is a plan) of everything that a parsed plan holds:
    plans, expressions, table specifications and pairs of options, wherever they are kept -
    inside commands, subqueries and common table expressions too."""
    gateway = spark.sparkContext._gateway
    is_a = lambda x, name: is_instance_of(gateway, x, name)
    queue, seen = [plan], 0
    while queue:
        part = queue.pop()
        if not isinstance(part, JavaObject):
            continue
        seen += 1
        if seen > _MOST_PARTS:
            raise Refused("The statement is too large to be checked.")
        if is_a(part, "org.apache.spark.sql.types.DataType"):
            continue
        product = is_a(part, "scala.Product")
        if product and not is_a(part, "scala.Option") and not is_a(part, "scala.collection.immutable.$colon$colon"):
            yield part.getClass().getSimpleName().removesuffix("$"), part, is_a(part, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
            inner = part.productIterator()
        elif is_a(part, "scala.collection.IterableOnce"):
            inner = part.iterator()
        else:
            continue
        while inner.hasNext():
            queue.append(inner.next())


def _known_schema(spark: SparkSession, name: str) -> bool:
    return name.lower() in _ALWAYS_THERE or spark.catalog.databaseExists(f"`{name.replace('`', '``')}`") or name in {c.name for c in spark.catalog.listCatalogs()}


def assess_spark(spark: SparkSession, sql: str, allow_writes: bool = False) -> Assessment:
    """Classify one Spark statement by its plan; Refused if it may not run.

    Spark's parser decides what the statement is, so comments, quotes and case hide nothing.
    Refused under any profile: plan nodes that are not listed, functions that call into the
    host, names that are only known when the statement runs, files in place of tables, and
    tables, views or schemas that name a place of their own.
    """
    _single(lex(sql, "spark"))
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except ParseException as error:
        raise Refused(f"Spark cannot parse the statement: {str(error).splitlines()[0]}") from None
    kinds = set()
    for name, part, is_plan in _parts(spark, plan):
        if is_plan:
            if name not in _SPARK_KIND:
                raise Refused(f"The plan node {name} is not recognized and remains blocked.")
            kinds.add(_SPARK_KIND[name])
        match name:
            case "UnresolvedFunction":
                names = part.nameParts()
                if names.apply(names.size() - 1).lower() in _HOST_FUNCTIONS:
                    raise Refused("Functions that call into the host are blocked.")
            case "ExpressionWithUnresolvedIdentifier" | "PlanWithUnresolvedIdentifier":
                raise Refused("Names that are computed when the statement runs are blocked.")
            case "UnresolvedRelation" | "UnresolvedTable" | "UnresolvedTableOrView" | "UnresolvedIdentifier" | "UnresolvedView":
                names = part.nameParts() if name == "UnresolvedIdentifier" else part.multipartIdentifier()
                if names.size() == 2 and not _known_schema(spark, names.apply(0)):
                    raise Refused("Reading a path as a table is blocked, and so are unknown schemas.")
                if name == "UnresolvedRelation" and any(not k.startswith("__") for k in part.options().asCaseSensitiveMap()):  # the parser's own marks
                    raise Refused("Options of a table are blocked.")
            case "UnresolvedTableSpec" | "TableSpec":
                if part.location().isDefined():
                    raise Refused("Statements that name a path are blocked.")
            case "Tuple2":
                key, value = part._1(), part._2()
                plain = not isinstance(value, JavaObject) or value.getClass().getSimpleName() == "Literal"
                if isinstance(key, str) and plain and key.lower() in _PLACES:
                    raise Refused("Statements that name a path are blocked.")
    kinds.discard("read")
    if not kinds:
        return Assessment.of("read")
    if not allow_writes:
        raise Refused("This session is read-only; data and schema changes must be enabled for it first.")
    return Assessment.of(sorted(kinds, key=list(_SPARK_OPERATIONS).index)[-1])


def permit(assessment: Assessment, confirmed: bool) -> None:
    """Refuse what needs a confirmation that was not given."""
    if assessment.requires_confirmation and not confirmed:
        raise Refused(f"{assessment.label} must be confirmed before it runs.")
