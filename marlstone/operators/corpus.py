"""Corpus preparation: screens, exact dedup, chunk windows, near-duplicate groups, splits
and validation. Documents have doc_id, text, lang and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.shingles import as_bytes, shingle_hashes, slices
from marlstone.operators.components import connected_components
from marlstone.operators.overlaps import intersections
from marlstone.operators.skew import salted_join, total_of
from marlstone.plans.materialize import materialize

CHUNK, OVERLAP, LEAST_CHARS = 3000, 240, 120
SHINGLE, SKETCH, BANDS, LEAST_SKETCH, NEAR = 5, 128, 8, 32, 0.85
SEED = "marlstone-v1"
#: Texts of a block that share a hash; bytes of a benchmark's runs that may be broadcast.
BLOCK, BROADCAST = 512, 64 << 20


def screened(docs: DataFrame, patterns: tuple[str, ...] = T.SECRET_PATTERNS + T.EXTRA_SECRET_PATTERNS, least: int = LEAST_CHARS) -> DataFrame:
    """Every document with its tidy text, status ('included' or 'skipped') and the reason:
    empty, then invalid characters, then secrets, then too short."""
    tidy = docs.withColumn("text", T.tidy(F.coalesce("text", F.lit(""))))
    reason = (F.when(F.col("text") == "", "empty").when(F.col("text").contains("�") | F.col("text").contains("\0"), "invalid characters")
              .when(T.any_match(F.col("text"), patterns), "possible secret").when(F.char_length("text") < least, "too short"))
    return tidy.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "included").otherwise("skipped"))


def exact_documents(docs: DataFrame) -> DataFrame:
    """One row per text: id (its sha256), text, and the merged provenance: first_id, copies,
    sorted sources and langs. The texts of a group are equal, so the least one is any of them."""
    return docs.groupBy(T.digest(F.col("text")).alias("id")).agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("lang")).alias("langs"), F.min("text").alias("text"))


def windows(text: str, limit: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks. A chunk may end behind any newline of its second
    half, failing that behind any space of it, and takes the last such place; failing both
    it has the full length. The next one starts `overlap` characters before the end."""
    if limit < 100 or not 0 <= overlap < limit // 2:
        raise ValueError("the limit must be 100 or more and the overlap under half of it")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = [np.flatnonzero(codes == ord(mark)) + 1 for mark in "\n "]

    def end_of(start: int) -> int:
        full = start + limit
        if full >= len(text):
            return len(text)
        last = (int(behind[k - 1]) for behind in places if (k := np.searchsorted(behind, full, "right")))
        return next((end for end in last if end > start + limit // 2), full)

    spans: list[tuple[int, int]] = []
    start = 0
    while start < len(text) and (not spans or spans[-1][1] < len(text)):
        spans.append((start, end_of(start)))
        start = max(start + 1, spans[-1][1] - overlap)
    return spans


def chunks(docs: DataFrame, id_col: str = "doc_id", limit: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, index, start_char, end_char, chunk) of every window with text; the index
    counts blank windows too. The recurrence is sequential, hence an Arrow function."""
    windows("", limit, overlap)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(windows(text or "", limit, overlap)):
                    if not text[a:b].isspace():
                        at.append(i)
                        rows.append((k, a, b, text[a:b]))
            kinds = [("index", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("chunk", pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(kinds)]],
                                             names=["doc_id", *[n for n, _ in kinds]])

    return docs.select(id_col, "text").mapInArrow(run, f"doc_id {id_type}, index int, start_char int, end_char int, chunk string")


def distinct_chunks(made: DataFrame) -> DataFrame:
    """One row per chunk text: id, first_doc, and its spans sorted by document and index."""
    return made.groupBy(T.digest(F.col("chunk")).alias("id")).agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("spans"), F.max(F.char_length("chunk")).alias("chars"))


def shared_chunk_edges(made: DataFrame) -> DataFrame:
    """(u, v) from every document of a chunk to the first document that holds it. A chunk
    that very many documents hold is spread over tasks."""
    keyed = made.select(T.digest(F.col("chunk")).alias("id"), "doc_id").distinct()
    first = materialize(keyed.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "first-holders")
    linked = salted_join(keyed, first, ["id"], "n", total_of(first, "n"), ["doc_id"])
    return linked.filter("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """Distinct runs of `width` words, joined by spaces; none for shorter texts."""
    listed = F.transform(F.array(T.words(text)), lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(listed[0])


def sketch(text: Column, width: int = SHINGLE, size: int = SKETCH) -> Column:
    """The `size` smallest 64-bit hash prefixes (hex) of the text's shingles, sorted."""
    return F.slice(F.array_sort(F.transform(shingles(text, width), lambda s: F.substring(F.sha2(s, 256), 1, 16))), 1, size)


def _similar(threshold: float):
    """Pairs of one block pair (h, lo, hi) of rows (own, id, sig: 8 bytes a hash) whose sketches
    are similar; of two blocks only pairs across them."""
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.int64) for x in table.column("sig").to_pylist()]
        both = intersections(sets).astype(np.float64)
        size = np.array([len(x) for x in sets], np.float64)
        union = size[:, None] + size[None, :] - both
        fits = np.triu(both >= threshold * union - 1e-9, 1)
        if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
            own = table.column("own").to_numpy()
            fits &= own[:, None] != own[None, :]
        i, j = np.nonzero(fits)
        ids = table.column("id").combine_chunks()
        return pa.table({"x": ids.take(pa.array(i)), "y": ids.take(pa.array(j)), "both": pa.array(both[i, j].astype(np.int32)), "all": pa.array(union[i, j].astype(np.int32))})

    return run


def near_pairs(docs: DataFrame, threshold: float = NEAR, id_col: str = "id", bands: int = BANDS, least: int = LEAST_SKETCH) -> DataFrame:
    """(a, b, sampled_jaccard) of texts whose sketches are similar, a > b.

    Candidates share one of the `bands` smallest hashes. Rows of one id are copies of one text
    and count once; texts are sketched where they are read, and only sketches move, 8 bytes a
    hash. Of hashes that the same texts hold (two 64-bit sums over their ids) one is compared,
    as the others have the same pairs. The texts of one hash are
    cut into blocks of about `BLOCK`, and pairs of blocks are compared each in a task of
    bounded size, however many texts share a hash; only similar pairs come back.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sketched = docs.select(F.col(id_col).alias("id"), sketch(F.col("text")).alias("sig")).filter(F.size("sig") >= least)
    sketched = materialize(sketched.select("id", F.unhex(F.array_join("sig", "")).alias("sig")).dropDuplicates(["id"]), "sketches")
    band = F.sequence(F.lit(0), F.least(F.lit(bands), (F.octet_length("sig") / 8).cast("int")) - 1)
    spread = sketched.filter(F.octet_length("sig") > 0).select("id", F.explode(F.transform(band, lambda i: F.substring(F.col("sig"), 8 * i + 1, F.lit(8)))).alias("h"))
    holders = spread.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("two")).filter("n > 1")
    shared = holders.groupBy("n", "one", "two").agg(F.min("h").alias("h")).select("h", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = materialize(shared, "shared-hashes")
    held = salted_join(spread, shared, ["h"], "n", total_of(shared, "n"), ["id"]).join(sketched, "id")
    dealt = (held.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))
    found = dealt.select("h", "lo", "hi", "own", "id", "sig").groupBy("h", "lo", "hi").applyInArrow(_similar(threshold), f"x {id_type}, y {id_type}, both int, all int").distinct()
    scored = found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), (F.col("both") / F.col("all")).alias("score")).distinct()
    return scored.filter(F.col("score") >= threshold).select("a", "b", F.round("score", 4).alias("sampled_jaccard"))


def grouped(docs: DataFrame, edges: DataFrame, seed: str = SEED, id_col: str = "id") -> DataFrame:
    """(id, group_id, split): documents that edges (u, v) connect share the least id as
    their group, and a group's split depends on the group alone."""
    found = connected_components(edges).select(F.col("node").alias(id_col), F.col("component").alias("group_id"))
    joined = docs.select(id_col).join(found, id_col, "left").withColumn("group_id", F.coalesce("group_id", id_col))
    return joined.withColumn("split", T.split_of(F.col("group_id").cast("string"), seed))


def _run_hashes(width: int):
    """(id, hashes of the distinct runs of `width` words) of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = as_bytes(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                hashes, bounds = shingle_hashes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))], names=["id", "h"])

    return run


def _sharing(width: int, wanted: np.ndarray):
    """(id) of the texts (id, text) with a run whose hash is among the sorted ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _run_hashes(width)(batches):
            hashes = made.column(1).flatten().to_numpy()
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            hits = np.concatenate(([0], np.cumsum(wanted[at] == hashes)))
            ends = made.column(1).offsets.to_numpy()
            yield made.select(["id"]).filter(pa.array(hits[ends[1:]] > hits[ends[:-1]]))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, most_bytes: int = BROADCAST) -> DataFrame:
    """(doc_id, item_id, shared): benchmark items and documents with common runs of `width`
    words. The benchmark's runs are counted once each.

    Where the benchmark's runs are measured to take at most `most_bytes`, their hashes go to
    all tasks, documents without any of them are left out where they are read, and the runs
    themselves are compared for the others only. Else the runs of both sides are shuffled.
    """
    items = materialize(benchmark.select("item_id", F.explode(shingles(F.col("text"), width)).alias("s")), "benchmark-runs")
    size = items.agg(F.coalesce(F.sum(F.octet_length("s") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    some = docs.select("doc_id", "text")
    if 0 < size <= most_bytes:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        found = items.select("item_id", F.col("s").alias("text")).mapInArrow(_run_hashes(width), f"id {benchmark.schema['item_id'].dataType.simpleString()}, h array<long>")
        wanted = np.sort(found.select(F.explode("h").alias("h")).distinct().toPandas()["h"].to_numpy(np.int64))
        near = some.mapInArrow(_sharing(width, wanted), f"id {id_type}").distinct()
        hit = materialize(near.withColumn("_any", F.lit(True)), "near-documents")
        some = some.join(hit, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        items = F.broadcast(items)
    return some.select("doc_id", F.explode(shingles(F.col("text"), width)).alias("s")).join(items, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def violations(docs: DataFrame, made: DataFrame, groups: DataFrame, limit: int = CHUNK) -> DataFrame:
    """(rule, violations) of a prepared corpus; every count must be 0.

    docs (id, text, and sources if their provenance is to be checked), chunks (doc_id, index,
    start_char, end_char, chunk, and quality_flags and training_eligible if those are), groups
    (id, group_id, split).
    """
    joined = made.join(docs.select(F.col("id").alias("doc_id"), "text"), "doc_id", "left")
    one = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    rules = [
        one(docs.filter(T.digest(F.col("text")) != F.col("id")), "document identity"),
        one(docs.groupBy("id").count().filter("count > 1"), "document uniqueness"),
        one(made.filter((F.char_length("chunk") > limit) | (F.char_length("chunk") == 0)), "chunk length"),
        one(joined.filter(F.col("text").isNull()), "span document"),
        one(joined.filter(F.expr("substring(text, start_char + 1, end_char - start_char) <> chunk")), "span text"),
        one(groups.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1"), "split leakage"),
        one(groups.join(docs.select("id"), "id", "left_anti"), "group document")]
    if "sources" in docs.columns:
        rules.append(one(docs.filter(F.coalesce(F.size("sources"), F.lit(0)) <= 0), "document provenance"))
    if "training_eligible" in made.columns:
        rules.append(one(made.filter(F.col("training_eligible") & (F.size("quality_flags") > 0)), "flagged in training"))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def chunk_rollup(made: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per chunk text with what its documents bring: the number of spans, the least
    document's group and split, sorted dialects and source ids, flags, and whether all are
    eligible. The spans themselves are rows of `chunk_spans`, as a common chunk has many.

    chunks (doc_id, index, start_char, end_char, chunk), docs (id, group_id, split,
    dialects, source_ids, quality_flags, training_eligible).
    """
    joined = made.withColumn("cid", T.digest(F.col("chunk"))).join(docs.withColumnRenamed("id", "doc_id"), "doc_id")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return joined.groupBy(F.col("cid").alias("id")).agg(
        F.min("chunk").alias("text"), F.count("*").alias("spans"), F.min_by("group_id", "doc_id").alias("group_id"),
        F.min_by("split", "doc_id").alias("split"), merged("dialects"), merged("source_ids"), merged("quality_flags"),
        F.bool_and("training_eligible").alias("training_eligible"))


def chunk_spans(made: DataFrame) -> DataFrame:
    """(id, doc_id, index, start_char, end_char): where each chunk text occurs."""
    return made.select(T.digest(F.col("chunk")).alias("id"), "doc_id", "index", "start_char", "end_char")


def export_sets(docs: DataFrame, rolled: DataFrame, audit: DataFrame, near: DataFrame) -> dict[str, DataFrame]:
    """What a corpus is published as, by name: documents, chunks, inventory, near_duplicates,
    review (documents with flags), and the eligible chunks of train, validation and test.

    docs (id, quality_flags, sources, training_eligible, ...), rolled (of `chunk_rollup`).
    """
    review = docs.filter(~F.col("training_eligible")).select(F.col("id").alias("document_id"), F.col("quality_flags").alias("flags"), F.col("sources").alias("provenance"))
    sets = {"documents": docs, "chunks": rolled, "inventory": audit, "near_duplicates": near, "review": review}
    return sets | {split: rolled.filter(F.col("training_eligible") & (F.col("split") == split)) for split in ("train", "validation", "test")}


def report(docs: DataFrame, rolled: DataFrame, audit: DataFrame, near: DataFrame) -> DataFrame:
    """(section, key, n): the counts of a corpus - totals, documents by source, chunks by
    dialect, training chunks by split, flags, statuses, reasons, and the largest group."""
    total = lambda df, key, n=None: df.agg((F.count("*") if n is None else n).cast("long").alias("n")).select(F.lit("totals").alias("section"), F.lit(key).alias("key"), "n")
    by = lambda df, section, key: df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "key", "n")
    sections = [
        total(docs, "documents"), total(docs, "characters", F.coalesce(F.sum(F.char_length("text")), F.lit(0))), total(rolled, "chunks"), total(near, "near pairs"),
        total(docs.filter(~F.col("training_eligible")), "review documents"),
        total(docs.groupBy("group_id").count(), "largest group", F.coalesce(F.max("count"), F.lit(0))),
        by(docs.select(F.explode("sources").alias("k")), "documents by source", F.col("k")), by(rolled.select(F.explode("dialects").alias("k")), "chunks by dialect", F.col("k")),
        by(rolled.filter("training_eligible"), "training chunks by split", F.col("split")), by(docs.select(F.explode("quality_flags").alias("k")), "quality flags", F.col("k")),
        by(audit, "inventory status", F.col("status")), by(audit.filter("reason is not null"), "skip reasons", F.col("reason"))]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out
