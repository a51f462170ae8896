"""Vectorised helpers over the UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes together, so that temporary arrays stay small; a longer row stands alone."""
    lo, rows = 0, len(offs) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Spans:
    """64-bit hashes of any spans of one byte array, from one running sum."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Spans._up) <= len(data):
            n = max(len(data) + 1, PIECE * 2)
            one = np.ones(1, np.uint64)
            Spans._up = np.cumprod(np.concatenate([one, np.full(n, ODD)]))
            Spans._down = np.cumprod(np.concatenate([one, np.full(n, INVERSE)]))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * Spans._up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Spans._down[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of each window of `width` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * Spans._down[:n]) if n > 0 else np.zeros(0, np.uint64)
