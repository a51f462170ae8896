"""Suffix arrays of byte strings by two-stage sorting, sorted as deep as a match is long."""

from __future__ import annotations

import numpy as np

SEPARATOR = 255  # no UTF-8 text has this byte


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def two_stage(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of data in order of their first `depth` bytes (ties in any order).

    Only suffixes smaller than their successor are sorted directly. Buckets by first byte are then scanned from the
    smallest on: each suffix found puts the one before it, where that is larger than its successor, at the next place
    of its own bucket, before the bucket's directly sorted part.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    differs = np.ones(n, bool)
    differs[:-1] = data[:-1] != data[1:]
    falls = np.ones(n, bool)
    falls[:-1] = data[:-1] > data[1:]
    next_ = np.where(differs, np.arange(n), n - 1)
    next_ = np.minimum.accumulate(next_[::-1])[::-1]
    larger = falls[next_]
    small = np.flatnonzero(~larger)
    packed = words_at(data)
    keys = []
    for off in range(0, depth, 8):
        at = small + off
        keys.append(np.where(at < n, packed[np.minimum(at, n - 1)], 0))
    small = small[np.lexsort(keys[::-1])] if len(small) else small
    ends = np.searchsorted(data[small], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[data[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []
    for c in range(256):
        front = np.concatenate(pending[c]) if pending[c] else small[:0]
        parts = []
        while len(front):
            parts.append(front)
            front = front[front > 0] - 1
            front = front[data[front] == c]
        bucket = np.concatenate([*parts, small[ends[c] : ends[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = data[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(first)]):
            pending[first[lo]].append(before[lo:hi])
    return np.concatenate(out)


def equal_runs(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Numbers for sorted positions: neighbours share one where their common prefix has `width` bytes or more."""
    packed = words_at(data)
    same = np.ones(max(0, len(order) - 1), bool)
    for off in [*range(0, width - 7, 8), width - 8]:
        live = np.flatnonzero(same)
        same[live] = packed[order[live] + off] == packed[order[live + 1] + off]
    return np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
