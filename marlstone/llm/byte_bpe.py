"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a tiktoken file become a BPE model of the tokenizers library: a token's
rank is its id, and every split of a token into two tokens is a merge, ordered by the
rank of what it makes. Bytes are written as the printable characters of the byte-level
alphabet on the way in and read back through the reverse table on the way out, so
characters that are split between tokens come back whole.

A text is cut where white space follows something else. The split pattern always starts
a match there, so the segments can be encoded on their own; each task encodes a segment
once and keeps a bounded table of them. Offsets are byte positions in the UTF-8 text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import workers

#: Most segments that a task keeps.
CACHE = 300_000
# The characters with the Unicode property White_Space.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SEGMENT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        to_char = byte_characters()
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        spell = {t: "".join(to_char[b] for b in t) for t in ranks}
        merges = [(spell[t[:i]], spell[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__)
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE({spell[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "removed", invert=True),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.known: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the segments learnt first, most of which are the frequent ones."""
        kept = min(len(self.known), CACHE // 4)
        self.known = dict(islice(self.known.items(), kept))
        self.first = self.first[:kept + 1].copy()
        self.flat = self.flat[:self.first[-1]].copy()

    def _learn(self, segments: list[str]) -> None:
        """Append the ids of new segments. Those that start with white space and end
        otherwise are encoded many at a time, as one text, and told apart by their bytes."""
        joined = [s for s in segments if s[0] in _WS and s[-1] not in _WS]
        alone = [s for s in segments if not (s[0] in _WS and s[-1] not in _WS)]
        groups = [joined[i:i + 256] for i in range(0, len(joined), 256)] + [[s] for s in alone]
        flat, first, total, count = [self.flat], [self.first], len(self.flat), len(self.first) - 1
        for a in range(0, len(groups), 64):
            part = groups[a:a + 64]
            for group, made in zip(part, self.tokenizer.encode_batch_fast(["".join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(made.ids, np.int32)
                ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) for s in group])) + 1
                self.known.update(zip(group, range(count, count + len(group)), strict=True))
                flat.append(ids)
                first.append(total + ends)
                total, count = total + len(ids), count + len(group)
        self.flat, self.first = np.concatenate(flat), np.concatenate(first)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [_SEGMENT.findall(t) for t in texts]
        segments = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.known.get, segments, repeat(-1)), np.int64, len(segments))
        missing = np.flatnonzero(at < 0).tolist()
        self._learn(list({segments[i] for i in missing}))
        at[missing] = [self.known[segments[i]] for i in missing]
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + size, size)]
        if len(self.known) > CACHE:
            self._forget()
        stops = np.concatenate(([0], ends))[np.cumsum([len(c) for c in cut], dtype=np.int64)].tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905

    def byte_starts(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the bytes of the text."""
        size = self.sizes[ids]
        return (np.cumsum(size) - size).astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, which are the text's only as a whole: one token may hold
        part of a character. IndexError for an id that the vocabulary lacks."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The coder of a rank file, made once in each worker."""
    return ByteBPE(read_ranks(path), pattern)


def public_ranks() -> tuple[str, str]:
    """(path, pattern) of the 50k byte-level vocabulary; read by each worker from its own
    installation, never shipped."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _coder(path: str | None, pattern: str | None) -> ByteBPE:
    known = (path, pattern) if path and pattern else public_ranks()
    return load(path or known[0], pattern or known[1])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """(doc_id, ids array<int>[, starts array<int>]) of every row.

    starts[i] is the byte at which token i starts in the UTF-8 text. A null or empty text
    has no tokens. Repeated rows give equal rows; other columns are not used.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in workers.batches("byte_bpe", batches, load.cache_clear):
            coder = coder or _coder(path, pattern)
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                made = coder.encode(part.column(1).fill_null("").to_pylist())
                bounds = np.concatenate(([0], np.cumsum([len(m) for m in made]))).astype(np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(made)))]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([coder.byte_starts(m) for m in made]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"][:len(columns)])

    schema = "doc_id long, ids array<int>" + ", starts array<int>" * offsets
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`coded`, with `ids` kept and `bytes binary` added; null ids give null bytes."""
    names = [c for c in coded.columns if c != "bytes"]
    chosen = coded.select(*names)
    schema = chosen.withColumn("bytes", F.lit(None).cast("binary")).schema
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in workers.batches("byte_bpe", batches, load.cache_clear):
            coder = coder or _coder(path, pattern)
            ids = batch.column(at)
            bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            gone = ids.is_null().to_pylist()
            out = [None if gone[i] else coder.decode(flat[bounds[i]:bounds[i + 1]].tolist()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "bytes"])

    return chosen.mapInArrow(run, schema)
