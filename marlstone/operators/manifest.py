"""Collection manifests: resources (url, status, kind, path, bytes, sha256, references)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.materialize import materialize


def merge(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """New rows win by key; rows only the old manifest has are kept."""
    return new.select(*old.columns).unionByName(old.join(new.select(key), key, "left_anti").select(*old.columns))


def upsert_references(resources: DataFrame, found: DataFrame) -> DataFrame:
    """(url, references): references found (url, reference) are added to those that a
    resource has (url, references), each once, in sorted order."""
    every = resources.select("url", F.explode_outer("references").alias("reference")).unionByName(found.select("url", "reference"))
    return every.groupBy("url").agg(F.array_sort(F.collect_set("reference")).alias("references"))


def unavailable(resources: DataFrame) -> DataFrame:
    """Resources that were not downloaded."""
    return resources.filter(F.coalesce(F.col("status"), F.lit("")) != "downloaded")


def git_blob(content: Column) -> Column:
    """The sha1 by which git names a blob of these bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")), content))


def integrity_errors(resources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, errors) of resources whose file (path, content) is missing or differs in
    bytes or sha256."""
    joined = resources.join(files.select("path", "content"), "path", "left")
    errors = F.array_compact(F.array(
        F.when(F.col("content").isNull(), "missing"), F.when(F.octet_length("content") != F.col("bytes"), "bytes"),
        F.when(F.sha2("content", 256) != F.col("sha256"), "sha256")))
    return joined.select("path", errors.alias("errors")).filter(F.size("errors") > 0)


def collection_statistics(resources: DataFrame, by: str) -> DataFrame:
    """Per collection: records, unique paths and hashes, PDFs and unavailable records."""
    return resources.groupBy(by).agg(
        F.count("*").alias("records"), F.count_distinct("path").alias("paths"), F.count_distinct("sha256").alias("hashes"),
        F.count_if(F.col("kind") == "pdf").alias("pdfs"), F.count_if(F.coalesce(F.col("status"), F.lit("")) != "downloaded").alias("unavailable"))


def coverage(resources: DataFrame, releases: Sequence[str], subjects: dict[str, str]) -> DataFrame:
    """(release, subject, paths): the paths of each release whose title matches the
    subject's pattern; combinations without any are kept."""
    spark = resources.sparkSession
    wanted = spark.createDataFrame([(r, s) for r in releases for s in subjects], "release string, subject string")
    matched = resources.select("release", "path", F.explode(F.filter(F.array(*[F.when(F.col("title").rlike(p), s) for s, p in subjects.items()]), lambda x: x.isNotNull())).alias("subject"))
    found = matched.groupBy("release", "subject").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return wanted.join(found, ["release", "subject"], "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def reachable(edges: DataFrame, seeds: DataFrame, max_nodes: int | None = 300, max_rounds: int | None = 30) -> DataFrame:
    """(node, depth) within reach of the seeds (node) along edges (src, dst), by frontier
    joins. As a crawl would, it stops once more than `max_nodes` are known or `max_rounds`
    links were followed; with None for both it goes on until nothing new is reached."""
    seen = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    for depth in count(1) if max_rounds is None else range(1, max_rounds + 1):
        front = seen.filter(F.col("depth") == depth - 1)
        step = edges.join(front, edges["src"] == front["node"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        grown = materialize(seen.unionByName(step.withColumn("depth", F.lit(depth))), "reach")
        before, after = seen.count(), grown.count()
        seen = grown
        if after == before or (max_nodes is not None and after > max_nodes):
            break
    return seen


def metadata_errors(snapshots: DataFrame) -> DataFrame:
    """(directory, errors) of snapshots (directory, commit, url) with an unsafe directory,
    a commit that is not 40 hex digits, or a url that is not https."""
    bad = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("directory").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)), "directory"),
        F.when(~F.coalesce(F.col("commit").rlike("^[0-9a-f]{40}$"), F.lit(False)), "commit"),
        F.when(~F.coalesce(F.col("url").rlike(r"^https://[A-Za-z0-9.-]+/"), F.lit(False)), "url")))
    return snapshots.select("directory", bad.alias("errors")).filter(F.size("errors") > 0)


def seed_missing(existing: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """The existing rows and those seeds whose key is missing; nothing is overwritten."""
    return existing.unionByName(seeds.join(existing.select(key), key, "left_anti").select(*existing.columns))


def union_statistics(files: DataFrame, by: str) -> DataFrame:
    """Records and distinct contents (sha256) of each collection, and of 'all' together: a
    content that several collections hold counts once there."""
    counts = [F.count("*").alias("records"), F.count_distinct("sha256").alias("hashes")]
    return files.groupBy(by).agg(*counts).unionByName(files.agg(*counts).withColumn(by, F.lit("all")))


def collection_gaps(repositories: DataFrame, files: DataFrame) -> DataFrame:
    """(collection, kind, name, error): what a collection lacks. repositories (collection,
    repository, status, url, license_files), files (collection, url, status, document_status,
    error): repositories without license files, placeholders, and what was not downloaded."""
    row = lambda df, kind, name, error: df.select("collection", F.lit(kind).alias("kind"), name.alias("name"), error.alias("error"))
    none, late = F.lit(None).cast("string"), F.coalesce(F.col("status"), F.lit("")) != "downloaded"
    return (row(repositories.filter(F.coalesce(F.size("license_files"), F.lit(0)) <= 0), "missing license", F.col("repository"), none)
            .unionByName(row(files.filter(~late & (F.col("document_status") == "publisher_placeholder")), "placeholder", F.col("url"), none))
            .unionByName(row(files.filter(late), "unavailable", F.col("url"), F.col("error")))
            .unionByName(row(repositories.filter(late), "unavailable", F.col("url"), F.lit("Incomplete repository snapshot"))))


class Incomplete(ValueError):
    """A listing holds fewer entries than it must."""


def library_resources(anchors: DataFrame, least: int = 200) -> DataFrame:
    """(url, references): the resources of a library's tables, from anchors (version, language,
    title, publication, url), each reference once, in order. Incomplete if there are fewer than `least`."""
    ref = F.struct("version", "language", "title", "publication")
    found = materialize(anchors.filter("url is not null").groupBy("url").agg(F.array_sort(F.collect_set(ref)).alias("references")), "library")
    number = found.count()
    if number < least:
        raise Incomplete(f"only {number} resources were found")
    return found
