"""Changes to immutable tables: each returns the new version as a frame, to be written
beside the old one. Triggers are explicit steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Immutable(ValueError):
    """The table takes appends only."""


def _guard(immutable: bool, what: str) -> None:
    if immutable:
        raise Immutable(f"posted rows are immutable: {what} is refused")


def insert_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table and those new rows whose key it lacks; of new rows with one key, one."""
    fresh = new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], immutable: bool = False) -> DataFrame:
    """New rows replace those of their key and are added where there is none. Keys must be
    unique in both; nulls in a new row replace too."""
    _guard(immutable, "an upsert")
    fresh = new.select(*table.columns).withColumn("_new", F.lit(True))
    both = table.alias("t").join(fresh.alias("n"), list(keys), "full")
    values = [c if c in keys else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in table.columns]
    return both.select(*values)


def update(table: DataFrame, where: Column, values: dict[str, Column], immutable: bool = False) -> DataFrame:
    """Rows for which `where` is true take the values, all computed from the old row."""
    _guard(immutable, "an update")
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column, immutable: bool = False) -> DataFrame:
    """The table without the rows for which `where` is true."""
    _guard(immutable, "a delete")
    return table.filter(~F.coalesce(where, F.lit(False)))


def affected(table: DataFrame, where: Column, operation: str) -> DataFrame:
    """(operation, affected_rows) of an update or delete."""
    return table.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("affected_rows")).select(F.lit(operation).alias("operation"), "affected_rows")


def cascade_delete(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]], root: str, where: Column) -> dict[str, DataFrame]:
    """All tables after the root's rows are deleted, and along links (parent, parent_key,
    child, child_key), parents before children, the rows that pointed to deleted ones."""
    gone = {root: tables[root].filter(F.coalesce(where, F.lit(False)))}
    left = dict(tables) | {root: delete(tables[root], where)}
    for parent, pk, child, ck in links:
        if parent in gone:
            lost = gone[parent].select(F.col(pk).alias("_lost")).distinct()
            on = F.col(ck) == F.col("_lost")
            dead = left[child].join(lost, on, "left_semi")
            gone[child] = gone[child].unionByName(dead) if child in gone else dead
            left[child] = left[child].join(lost, on, "left_anti")
    return left


def status_audit(old: DataFrame, new: DataFrame, key: str, status: str, entity: str) -> DataFrame:
    """Audit rows (entity_type, entity_id, action, changes_json) for every change of status."""
    both = old.select(key, F.col(status).alias("_old")).join(new.select(key, F.col(status).alias("_new")), key).filter(F.col("_old") != F.col("_new"))
    changes = F.to_json(F.struct(F.col("_new").alias("new"), F.col("_old").alias("old")))
    return both.select(F.lit(entity).alias("entity_type"), F.col(key).alias("entity_id"), F.lit("STATUS_CHANGED").alias("action"), changes.alias("changes_json"))


def touched(table: DataFrame, where: Column, values: dict[str, Column], stamp: str, now: Column | None = None, immutable: bool = False) -> DataFrame:
    """An update that also sets the rows' time stamp, by default the present time in UTC."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if now is None else now
    return update(table, where, values | {stamp: now}, immutable)


def inserted(table: DataFrame, new: DataFrame, keys: Sequence[str], operation: str = "insert") -> DataFrame:
    """(operation, affected_rows): how many rows `insert_ignore` adds to the table."""
    return new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("affected_rows")).select(
        F.lit(operation).alias("operation"), "affected_rows")
