"""Vectorised word hashing and word shingles over Arrow string columns.

Words are maximal runs of bytes that are not ASCII white space. A document of 1 to 4
words has one shingle, all of its words; one without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_STEP = _U(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(n, base, _U)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """(first, last) document ranges of about `limit` bytes each, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts in bytes, n+1 offsets of each document's words)."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * power[:-1], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts])
    return hashes, starts, np.searchsorted(starts, offsets)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all `width`-word shingles, repeats included, and n+1 offsets."""
    hashes, _, bounds = words(raw, offsets)
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(made)))
    if not len(hashes):
        return np.zeros(0, _U), out
    doc = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out[-1]) - out[doc] + bounds[doc]
    end = bounds[doc + 1]
    total = np.zeros(len(at), _U)
    for j in range(width):
        word = hashes[np.minimum(at + j, len(hashes) - 1)]
        total = total * _STEP + np.where(at + j < end, word, _U(0))
    return mix64(total), out
