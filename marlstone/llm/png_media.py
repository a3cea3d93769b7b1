"""Bytes as PNG images and back, with a perceptual hash of what was read.

The payload (UTF-8 bytes, padded with byte 255 to a positive multiple of the row width)
is stored as 8-bit grey samples, one row of `WIDTH` samples after another, filtered
against the row above and compressed in zlib chunks. Reading checks the signature, every
chunk's CRC-32, the header, zlib's Adler-32 and the size, then undoes the filters in
numpy. The hash takes the low frequencies of a cosine transform of the shrunk image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of compressed data in one IDAT chunk; side of the shrunk image; side of the hash.
IDAT, SIDE, LOW = 1 << 16, 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """`data` with bytes 255 up to a positive multiple of `width`."""
    return data + b"\xff" * (-len(data) % width if data else width)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG whose rows are the payload's rows; the length must be a
    positive multiple of `width`. The first row has filter 0, the others filter 2 (up)
    where that makes them smoother, else 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    smooth = np.minimum(up, 0 - up).sum(axis=1, dtype=np.int64) < np.minimum(rows, 0 - rows).sum(axis=1, dtype=np.int64)
    smooth[0] = False
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = np.where(smooth, 2, 0)
    lines[:, 1:] = np.where(smooth[:, None], up, rows)
    packed = zlib.compress(lines.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i:i + IDAT]) for i in range(0, len(packed), IDAT))
    return _SIGNATURE + _chunk(b"IHDR", header) + data + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("the PNG ends within a chunk")
        size, kind = struct.unpack_from(">I4s", png, at)
        data, end = png[at + 8:at + 8 + size], at + 12 + size
        if end > len(png) or zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, end - 4)[0]:
            raise ValueError(f"the checksum of a {kind!r} chunk does not match")
        yield kind, data
        at = end


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of 8-bit grey lines (filter byte first); all five filters of the format."""
    out = lines[:, 1:].copy()
    kinds = lines[:, 0]
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    n, width = out.shape
    a = 0
    while a < n:  # runs of rows of one filter are undone together where the filter allows it
        b = a + 1
        while b < n and kinds[b] == kinds[a]:
            b += 1
        kind = kinds[a]
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(a, b):
                above = out[y - 1].astype(np.int64) if y else np.zeros(width, np.int64)
                left = corner = 0
                for x in range(width):
                    up = int(above[x])
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        p = left + up - corner
                        pa_, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
                        guess = left if pa_ <= pb and pa_ <= pc else up if pb <= pc else corner
                    left = out[y, x] = (int(out[y, x]) + guess) & 255
                    left, corner = int(left), up
        a = b
    return out


def decode_png(png: bytes) -> np.ndarray:
    """(rows, width) samples of an 8-bit greyscale PNG without interlacing; ValueError
    for anything else or anything damaged."""
    parts = list(_chunks(png))
    if not parts or parts[0][0] != b"IHDR" or parts[-1] != (b"IEND", b""):
        raise ValueError("IHDR or IEND is missing")
    width, height, *rest = struct.unpack(">IIBBBBB", parts[0][1])
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError("not 8-bit greyscale without interlacing")
    reader = zlib.decompressobj()
    data = reader.decompress(b"".join(d for k, d in parts if k == b"IDAT"))
    if not reader.eof or len(data) != height * (width + 1):
        raise ValueError("the image data have another size than the header says")
    return unfilter(np.frombuffer(data, np.uint8).reshape(height, width + 1))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


@lru_cache(maxsize=512)
def _edges(n: int) -> np.ndarray:
    return (np.arange(SIDE) * n) // SIDE


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: which of the 8 x 8 lowest frequencies of the image,
    shrunk to 32 x 32 means, lie over their median (the constant one left out of it)."""
    height, width = image.shape
    grid = image
    if height < SIDE:
        grid = np.repeat(image, -(-SIDE // height), axis=0)
    rows, cols = _edges(grid.shape[0]), _edges(width)
    total = np.add.reduceat(np.add.reduceat(grid, rows, axis=0, dtype=np.int64), cols, axis=1)
    count = np.outer(np.diff(rows, append=grid.shape[0]), np.diff(cols, append=width))
    cosines = _cosines()
    low = np.round(cosines @ (total / count) @ cosines.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary) of every row: the text's bytes as a PNG.

    A null text counts as empty and gives one row of bytes 255. Equal texts give equal
    images. Other columns are not used.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            for a in range(0, batch.num_rows, 256):
                part = data.slice(a, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, 256), pa.array([len(x) for x in part], pa.int64()),
                    pa.array([encode_png(pad(x)) for x in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """The columns of `media` but the image itself, and what reading it back gives:
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for png in batch.column(2).to_pylist():
                image = decode_png(png)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png),
                             hashlib.sha256(png).hexdigest(), cosine_hash(image)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
