"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the last `WINDOW` bytes is looked at where a word starts; in one of
`SPACING` cases (and at one of `DENSE` characters where the window holds no white space, at
one of `RARE` elsewhere) a chunk ends there, but no chunk is shorter than `LEAST` bytes. Borders depend on near bytes
only, so after an insertion they fall into step again. Chunks are compared by 128-bit
digest over all documents. All occurrences but the first (least doc_id, then position)
repeat; repeated chunks that follow each other form a run, and runs of `LEAST_RUN` bytes
or more are cut from the text. Shorter runs, such as a common phrase, stay.

Occurrences are counted with map-side combine, and joins spread hot digests over tasks.
Texts are read twice for their chunks rather than keeping the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import workers
from marlstone.llm.names import fresh, without
from marlstone.operators.skew import salted_join, total_of
from marlstone.plans.materialize import materialize

WINDOW, SPACING, RARE, LEAST, LEAST_RUN = 16, 5, 256, 16, 100
DENSE = 16
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash (shift left by two, add the byte's number) of the
    `WINDOW` bytes that end there; older bytes have left the 32 bits."""
    out = _GEAR[raw]
    step = 1
    while step < WINDOW:
        out[step:] += out[:-step] << np.uint32(2 * step)
        step *= 2
    return out


def chunk_starts(data: bytes) -> list[int]:
    """Byte positions at which the chunks of a UTF-8 text start, the first of them 0."""
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    value = gear(raw)[:-1] >> np.uint32(7)
    word = ~_SPACE[raw[1:]] & _SPACE[raw[:-1]]
    spaces = np.concatenate((np.ones(WINDOW, np.int64), np.cumsum(_SPACE[raw[:-1]]) + 1))
    solid = spaces[WINDOW:] == spaces[:-WINDOW]
    solid[:WINDOW - 1] = False
    rare = ((value % np.uint32(RARE) == 1) | (solid & (value % np.uint32(DENSE) == 1))) & ((raw[1:] & 0xC0) != 0x80)
    out, last = [0], 0
    for at in (np.flatnonzero((word & (value % np.uint32(SPACING) == 0)) | rare) + 1).tolist():
        if at - last >= LEAST:
            out.append(at)
            last = at
    return out


def _digests(data: bytes, starts: list[int]) -> np.ndarray:
    ends = [*starts[1:], len(data)]
    made = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts, ends, strict=True)])
    return np.frombuffer(made, ">i8").astype(np.int64).reshape(-1, 2)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, size, hi, lo): every chunk of every text, in bytes, with its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.batches("substring", batches):
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                doc, start, size, digest = [], [], [], []
                for i, data in enumerate(part.column(1).cast(pa.large_binary()).to_pylist()):
                    if data:
                        s = chunk_starts(data)
                        doc.append(np.full(len(s), i))
                        start.append(np.array(s, np.int32))
                        size.append(np.diff(start[-1], append=len(data)).astype(np.int32))
                        digest.append(_digests(data, s))
                if doc:
                    both = np.concatenate(digest)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(start)), pa.array(np.concatenate(size)),
                         pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "start", "size", "hi", "lo"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    return named.mapInArrow(run, "doc_id long, start int, size int, hi long, lo long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, size, hi, lo) of every chunk that occurred before."""
    all_ = chunks(docs, id_col, text_col)
    often = materialize(all_.groupBy("lo").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    some = materialize(salted_join(all_, often, ["lo"], "n", total_of(often, "n"), ["doc_id", "start"]).select("doc_id", "start", "size", "hi", "lo"), "repeats")
    firsts = materialize(some.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    return salted_join(some, firsts, ["hi", "lo"], "n", total_of(firsts, "n"), ["doc_id", "start"]).filter(
        F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "size", "hi", "lo")


def cut_runs(data: bytes, spans: list[tuple[int, int, int, int]], least_run: int = LEAST_RUN) -> list[tuple[int, int]]:
    """(start, end) of the runs to cut, from repeated chunks (start, size, hi, lo). Chunks
    that the text does not hold (another row of the same id did) are passed over."""
    runs: list[list[int]] = []
    for start, size, hi, lo in sorted(spans):
        digest = xxhash.xxh3_128_digest(data[start:start + size])
        if start + size > len(data) or digest != hi.to_bytes(8, "big", signed=True) + lo.to_bytes(8, "big", signed=True):
            continue
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + size)
        else:
            runs.append([start, start + size])
    return [(a, b) for a, b in runs if b - a >= least_run]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN,
                    count_col: str = "cut_chars") -> DataFrame:
    """The documents, all columns, with repeated passages cut from the text, and
    `count_col`, the number of characters cut (an existing column of that name is replaced).

    A text that repeats in full is left empty. Null texts and rows with a null id are left
    as they are; empty texts have no chunks. Rows of one id count as one document, so a
    repeated row keeps the first occurrences that its twin keeps. Empty input gives an
    empty result.
    """
    base = docs.select(*without(docs.columns, count_col))
    held, spanned = fresh(docs.columns, "spans", "spanned")
    spans = repeated_chunks(docs, id_col, text_col).groupBy(F.col("doc_id").alias(spanned)).agg(F.collect_set(F.struct("start", "size", "hi", "lo")).alias(held))
    joined = base.join(spans, base[id_col].cast("long") == F.col(spanned), "left").drop(spanned)
    schema = base.withColumn(count_col, F.lit(0)).schema
    names = [*base.columns, count_col]
    at, last = [n.lower() for n in names].index(text_col.lower()), len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.batches("substring", batches):
            texts, cut = batch.column(at).to_pylist(), np.zeros(batch.num_rows, np.int32)
            for i, spans_ in enumerate(batch.column(last).to_pylist()):
                if spans_ and texts[i]:
                    data, kept, done = texts[i].encode(), [], 0
                    for a, b in cut_runs(data, [(s["start"], s["size"], s["hi"], s["lo"]) for s in spans_], least_run):
                        kept.append(data[done:a])
                        done = b
                    text = (b"".join(kept) + data[done:]).decode()
                    cut[i], texts[i] = len(texts[i]) - len(text), text
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(last)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut)], names=names)

    return joined.mapInArrow(run, schema)
