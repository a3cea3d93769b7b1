"""The workbench's own tables: profiles, schema cache, sessions, messages, outputs and
query history, each kept as numbered Parquet versions. A change writes the next version;
readers take the newest. Profiles hold no secrets."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import dml
from marlstone.sources import sinks

SCHEMAS = {
    "profiles": "id string, name string, engine string, path string, allow_writes boolean, tls_mode string, updated_at string",
    "schema_cache": "profile_id string, snapshot string, captured_at string",
    "chat_sessions": "id string, profile_id string, title string, mode string, created_at string, updated_at string",
    "chat_messages": "id string, session_id string, role string, text string, created_at string",
    "query_outputs": "id string, session_id string, source_message_id string, sql string, result string, created_at string",
    "query_history": "id string, profile_id string, sql string, outcome string, elapsed_ms long, ran_at string"}
#: (parent, key, child, key), parents first.
LINKS = [("profiles", "id", "schema_cache", "profile_id"), ("profiles", "id", "chat_sessions", "profile_id"), ("profiles", "id", "query_history", "profile_id"),
         ("chat_sessions", "id", "chat_messages", "session_id"), ("chat_sessions", "id", "query_outputs", "session_id")]
DEFAULT_TITLE = "New conversation"


class History:
    """One writer at a time; `root` is a folder that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The newest version, empty before the first write."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{versions[-1]}")

    def change(self, name: str, how: Callable[[DataFrame], DataFrame]) -> None:
        """Write the version that `how` makes of the newest one."""
        versions = self._versions(name)
        how(self.read(name)).write.parquet(f"{self.root}/{name}/v{(versions[-1] if versions else 0) + 1}")

    def rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def save_profile(self, row: tuple) -> None:
        """Insert, or replace the profile of the same id."""
        self.change("profiles", lambda t: dml.upsert(t, self.rows("profiles", [row]), ["id"]))

    def cache_schema(self, row: tuple) -> None:
        self.change("schema_cache", lambda t: dml.upsert(t, self.rows("schema_cache", [row]), ["profile_id"]))

    def add_session(self, row: tuple) -> None:
        self.change("chat_sessions", lambda t: t.unionByName(self.rows("chat_sessions", [row])))

    def add_message(self, row: tuple) -> None:
        """Append; the first message of a user names a session that still has its default title."""
        new = self.rows("chat_messages", [row])
        self.change("chat_messages", lambda t: t.unionByName(new))
        _, session, role, text, at = row
        if role == "user" and text:
            title = self.spark.range(1).select(T.chat_title(F.lit(text)).alias("t")).first()["t"]
            where = (F.col("id") == session) & (F.col("title") == DEFAULT_TITLE)
            self.change("chat_sessions", lambda t: dml.update(t, where, {"title": F.lit(title), "updated_at": F.lit(at)}))

    def save_output(self, row: tuple) -> None:
        """Append unless the session has an output of the same message."""
        self.change("query_outputs", lambda t: dml.insert_ignore(t, self.rows("query_outputs", [row]), ["session_id", "source_message_id"]))

    def log_query(self, row: tuple) -> None:
        self.change("query_history", lambda t: t.unionByName(self.rows("query_history", [row])))

    def delete_profile(self, profile: str) -> None:
        """The profile and everything that hangs on it."""
        left = dml.cascade_delete({n: self.read(n) for n in SCHEMAS}, LINKS, "profiles", F.col("id") == profile)
        for name, df in left.items():
            self.change(name, lambda _, df=df: df)

    def backfill_outputs(self, at: str) -> None:
        """Save an output for every assistant message with a sql block that has none yet."""
        sql = T.sql_fence(F.col("text"))
        drafts = self.read("chat_messages").filter((F.col("role") == "assistant") & (sql != "")).select(
            F.concat(F.lit("out-"), "id").alias("id"), "session_id", F.col("id").alias("source_message_id"), sql.alias("sql"),
            F.lit(None).cast("string").alias("result"), F.lit(at).alias("created_at"))
        self.change("query_outputs", lambda t: dml.insert_ignore(t, drafts, ["session_id", "source_message_id"]))

    def profiles(self) -> DataFrame:
        return self.read("profiles").orderBy("name", "id")

    def sessions(self, profile: str) -> DataFrame:
        """Newest first."""
        return self.read("chat_sessions").filter(F.col("profile_id") == profile).orderBy(F.desc("updated_at"), "id")

    def messages(self, session: str) -> DataFrame:
        """Oldest first."""
        return self.read("chat_messages").filter(F.col("session_id") == session).orderBy("created_at", "id")

    def outputs(self, session: str) -> DataFrame:
        """Newest first."""
        return self.read("query_outputs").filter(F.col("session_id") == session).orderBy(F.desc("created_at"), "id")

    def export_output(self, output: str, folder: str) -> str:
        """Write one saved output as JSON to a new file of the driver's folder; its path.
        KeyError for an unknown output, FileExistsError if the file is there."""
        row = self.read("query_outputs").filter(F.col("id") == output).first()
        if row is None:
            raise KeyError(output)
        path = os.path.join(folder, f"output-{re.sub(r'[^A-Za-z0-9_-]', '', output)[:8]}.json")
        sinks.export_json(row.asDict(), path)
        return path
