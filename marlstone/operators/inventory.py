"""From files to documents: what is considered, why it is skipped, and one audit row each."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.skew import salted_join, total_of
from marlstone.plans.materialize import materialize
from marlstone.sources.extract import extract

# Folders and names that are never content, and the words of an audit.
EXCLUDED_PARTS = (".git", ".github", ".claude", "node_modules", "wwwroot", "vendor", "bin", "obj", "packages", "public")
EXCLUDED_NAMES = ("agents.md", "claude.md", "contributing.md", "summary.md", "code_of_conduct.md", "security.md")
REASONS = {"link": "symlink", "scope": "outside content allowlist", "large": "oversize", "empty": "empty", "short": "too little extracted text",
           "secret": "credential_pattern_requires_review"}
LICENSE_FILE = r"(?i)^(license|copying|notice|copyright|lgpl|gpl|epl)([._-]|$)"
PLAIN_FILES = ("readme", "changelog", "authors")
TOOL_FILES = ("agents.md", "claude.md", "skill.md", ".cursorrules")


def glob_match(path: Column, pattern: str) -> Column:
    """Whether a whole path fits a shell pattern; as in fnmatch, * and ? cross slashes."""
    return path.rlike("^(?:" + fnmatch.translate(pattern).replace("\\Z", "").replace("\\z", "") + ")\\z")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _name(path: Column) -> Column:
    return F.element_at(_parts(path), -1)


def hidden(path: Column, excluded: Sequence[str] = EXCLUDED_PARTS) -> Column:
    """Whether a part of the path is excluded or starts with a dot: such files are not considered."""
    return F.exists(_parts(path), lambda p: p.isin(*excluded) | p.startswith("."))


def included(path: Column, patterns: Sequence[str], names: Sequence[str] = EXCLUDED_NAMES) -> Column:
    """Whether the path fits one of the patterns and is not one of the excluded names."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | glob_match(path, p)
    return fits & ~F.lower(_name(path)).isin(*names)


def repository_selected(path: Column, prefixes: Sequence[str], documents: Sequence[str], examples: Sequence[str], blocked: Sequence[str],
                        data: Sequence[str] = ("docs/examples/data/",)) -> Column:
    """Whether a file of a source tree belongs to its documentation.

    Never: absolute paths, '..', blocked parts, data folders and files for tools. Always:
    license files. Else files of the root or under a prefix that are documents by extension or
    name, or, below the root, examples by extension.
    """
    parts, name = _parts(path), F.lower(_name(path))
    never = path.startswith("/") | F.array_contains(parts, "..") | F.arrays_overlap(parts, F.array(*[F.lit(b) for b in blocked])) | name.isin(*TOOL_FILES)
    for d in data:
        never = never | path.startswith(d)
    scope = F.size(parts) == 1
    for p in prefixes:
        scope = scope | (path == p) | path.startswith(p + "/")
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    wanted = suffix.isin(*documents) | name.isin(*PLAIN_FILES) | (suffix.isin(*examples) & (F.size(parts) > 1))
    return ~never & (_name(path).rlike(LICENSE_FILE) | (scope & wanted))


def resolved_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """The sources (source_id, notice, version, version_file, version_pattern, ...) with the
    sha256 of their notice and the version that a file of theirs states, if one is named.
    files (source_id, path, content). A declared notice that is missing gives a null digest."""
    text = files.select("source_id", "path", "content")
    notice = text.select("source_id", F.col("path").alias("notice"), F.sha2("content", 256).alias("notice_sha256"))
    stated = text.select("source_id", F.col("path").alias("version_file"), F.decode("content", "utf-8").alias("_body"))
    found = F.expr("regexp_extract(_body, version_pattern, 1)")
    return (sources.join(notice, ["source_id", "notice"], "left").join(stated, ["source_id", "version_file"], "left")
            .withColumn("version", F.when(F.col("_body").isNotNull() & (found != ""), found).otherwise(F.col("version"))).drop("_body"))


def inventory(files: DataFrame, sources: dict[str, Sequence[str]], least_chars: int = 120, most_bytes: int = 1_000_000,
              secrets: Sequence[str] = T.SECRET_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(audit, documents) of files (source_id, path, content binary, is_link boolean).

    audit has a row for every considered file: source_id, path, status ('skipped',
    'extraction-error', 'exact-document-duplicate' or 'included'), reason, document_id. The
    first file of a text, by the order of `sources` (id to include patterns) and path, is the
    one included. documents: id, text, sources, paths, quality_flags, training_eligible.
    """
    order = F.coalesce(*[F.when(F.col("source_id") == s, F.lit(i)) for i, s in enumerate(sources)])
    wanted = F.lit(False)
    for s, patterns in sources.items():
        wanted = wanted | ((F.col("source_id") == s) & included(F.col("path"), patterns))
    size = F.octet_length("content")
    early = (F.when(F.col("is_link"), REASONS["link"]).when(~wanted, REASONS["scope"]).when(size > most_bytes, REASONS["large"])
             .when(F.coalesce(size, F.lit(0)) == 0, REASONS["empty"]))
    seen = files.filter(order.isNotNull() & ~hidden(F.col("path"))).withColumn("rank", order).withColumn("early", early)
    whole = F.concat_ws("\u0001", F.col("rank").cast("string"), F.col("source_id"), F.col("path"))  # files of two sources may share a path
    read = extract(seen.filter("early is null").select(F.concat_ws("\u0001", whole, F.col("path")).alias("path"), "content"))
    late = (F.when(F.col("error").isNotNull(), None).when(F.char_length("text") < least_chars, REASONS["short"])
            .when(T.any_match(F.col("text"), tuple(secrets)), REASONS["secret"]))
    parts = F.split("path", "\u0001")
    flags = F.when(F.col("text").contains("�") | F.col("text").contains("\0"), F.array_append("flags", F.lit("invalid_text_characters"))).otherwise(F.col("flags"))
    read = materialize(read.select(parts[0].cast("int").alias("rank"), parts[1].alias("source_id"), parts[2].alias("path"), flags.alias("flags"), "error", late.alias("reason"),
                                   F.when(F.col("error").isNull() & late.isNull(), T.digest(F.col("text"))).alias("document_id"), "text"), "files")
    kept = read.filter("document_id is not null")
    first = materialize(kept.groupBy("document_id").agg(F.min(F.struct("rank", "path")).alias("first"), F.count("*").alias("n")), "first-files")
    marked = salted_join(kept.select("document_id", "source_id", "path", "rank"), first, ["document_id"], "n", total_of(first, "n"), ["path"])
    status = F.when(F.struct("rank", "path") == F.col("first"), "included").otherwise("exact-document-duplicate")
    columns = ["source_id", "path", "status", "reason", "document_id"]
    none = F.lit(None).cast("string")
    audit = (marked.withColumns({"status": status, "reason": none}).select(*columns)
             .unionByName(read.filter("reason is not null").withColumn("status", F.lit("skipped")).select(*columns))
             .unionByName(read.filter("error is not null").withColumns({"status": F.lit("extraction-error"), "reason": none}).select(*columns))
             .unionByName(seen.filter("early is not null").withColumns({"status": F.lit("skipped"), "reason": F.col("early"), "document_id": none}).select(*columns)))
    documents = kept.groupBy(F.col("document_id").alias("id")).agg(
        F.min("text").alias("text"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.array_sort(F.collect_set("path")).alias("paths"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("quality_flags")).withColumn("training_eligible", F.size("quality_flags") == 0)
    return audit, documents
