"""MinHash over the word shingles of Arrow string columns."""

from __future__ import annotations

import numpy as np

from marlstone.functions.shingles import as_bytes, mix64, power_tables, shingle_hashes, slices, words

__all__ = ["MinHash", "as_bytes", "mix64", "power_tables", "shingle_hashes", "slices", "words"]
_U = np.uint64


class MinHash:
    """`size` seeded 32-bit MinHash functions."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = size
        self.xor = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        self.mul = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signatures(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, size); rows of documents without shingles are all ones."""
        n = len(offsets) - 1
        out = np.full((n, self.size), 0xFFFFFFFF, np.uint32)
        folded = (hashes >> _U(32)).astype(np.uint32)
        for first, last in slices(offsets, 1 << 18):
            some = np.flatnonzero(np.diff(offsets[first:last + 1])) + first
            if not len(some):
                continue
            part, starts = folded[offsets[first]:offsets[last]], offsets[some] - offsets[first]
            for k in range(self.size):
                out[some, k] = np.minimum.reduceat((part ^ self.xor[k]) * self.mul[k], starts)
        return out
