"""Vectorised text kernels over Arrow string buffers, shared by the corpus operators.

Everything works on the raw UTF-8 bytes of a slice of documents, so no Python string is built per
word.  A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is exactly
``[^\\x20\\x09-\\x0D]+`` because those code points are single bytes in UTF-8.  Words are named by
64-bit hashes; two different words share one with probability 2**-64.

Null texts count as empty.  A slice holds about ``SLICE_BYTES`` of text, and at least one document,
so memory follows the longest document and not the batch that Arrow delivers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept for the worker's life."""
    have = _power.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _power[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: first row, end row, bytes, byte offsets of the rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    doc: np.ndarray  # row of each word within the slice
    start: np.ndarray  # byte offsets in the slice
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word, one more entry than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each [start, end), the same wherever they stand."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_MUL, n), out=total[1:])
    inv = _powers(_INV, n + 1)
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    if lower:
        buf = _LOWER[buf]
    inside = ~SPACE[buf]
    n = len(buf)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    if n:
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    else:
        start = end = np.zeros(0, dtype=np.int64)
    first = np.searchsorted(start, offs, "left")
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(doc, start, end, span_hashes(buf, start, end) if hashed else np.zeros(0, np.uint64), first)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and the index of each row's first (one more entry than rows).

    A row with 1 to k-1 words has one window, its whole sequence.
    """
    counts = w.counts
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    first = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(n, out=first[1:])
    base = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    size = np.repeat(np.minimum(counts, k), n)
    out = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(k):
        at = np.minimum(base + j, max(len(w.hash) - 1, 0))
        part = w.hash[at] * np.uint64(pow(_MUL, j + 1, 1 << 64)) if len(w.hash) else out
        out = out + (part if k == 1 else np.where(size > j, part, np.uint64(0)))
    return mix(out), first


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, in one array with offsets."""
    parts = [np.sort(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    keep = np.ones(len(flat), dtype=bool)
    if len(flat):
        keep[1:] = flat[1:] != flat[:-1]
        keep[first[:-1][np.diff(first) > 0]] = True
    offs = np.concatenate([[0], np.cumsum(keep)])[first]
    return flat[keep], offs


def list_array(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
