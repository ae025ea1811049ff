"""Vectorised text kernels shared by the operators: words, 64-bit word hashes, shingles, n-grams.

All kernels work on Arrow string buffers in numpy, a few megabytes at a time, so a Python worker's
memory is bounded by the slice size and the longest single text, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3 << 18
U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_IS_LETTER = _IS_WORD.copy()
_IS_LETTER[:128] = [chr(i).isalnum() for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(31))) * _C1
    x = (x ^ (x >> U(29))) * _C2
    return x ^ (x >> U(32))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.diff(offsets(batch.column(column))[1])
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def offsets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Raw bytes and offsets of a string or binary array; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, off, data = arr.buffers()
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if off is not None else np.zeros(len(arr) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a column slice.

    ``data`` padded bytes, ``start``/``length`` per word, ``off`` word offsets per document
    (documents i has words off[i]:off[i+1]), ``hash`` a 64-bit hash per word.  ``lower`` lower-cases A-Z;
    ``bare`` separates words at ASCII punctuation too.
    """

    def __init__(self, arr: pa.Array, lower: bool = False, hashed: bool = True, bare: bool = False):
        raw, off = offsets(arr)
        n = len(raw)
        data = np.zeros(n + 16, np.uint8)
        data[:n] = _LOWER[raw] if lower else raw
        self.data, self.byte_off = data, off
        inside = (_IS_LETTER if bare else _IS_WORD)[data[:n]]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        edge = off[(off > 0) & (off < n)]
        before[edge] = False
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.length = np.flatnonzero(inside & ~after) + 1 - self.start
        self.off = np.searchsorted(self.start, off)
        self.hash = word_hash(data, self.start, self.length) if hashed else None

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def word_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of ``data`` (padded by 8 bytes at least), eight bytes a step."""
    view = np.ndarray((max(len(data) - 8, 0),), "<u8", data, strides=(1,)) if len(data) > 8 else np.zeros(0, "<u8")
    h = mix(length.astype(np.uint64) * _C3 + _C1)
    if not len(start):
        return h
    h = mix(h ^ (view[start] & _MASK[np.minimum(length, 8)]))
    at, pos = np.flatnonzero(length > 8), 8
    while at.size:
        left = length[at] - pos
        h[at] = mix(h[at] ^ (view[start[at] + pos] & _MASK[np.minimum(left, 8)]))
        at, pos = at[left > 8], pos + 8
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (shorter by n-1), by doubling."""
    have, width, out, done = h, 1, None, 0
    rest = n
    while rest:
        if rest & 1:
            piece = have[done:]
            if out is None:
                out = piece
            else:
                m = min(len(out), len(piece))
                out = mix(out[:m] * _C2 + piece[:m] + U(done))
            done += width
        rest >>= 1
        if rest:
            have = mix(have[:-width] * _C1 + have[width:] + U(width)) if len(have) > width else have[:0]
            width *= 2
    return out[: max(0, len(h) - n + 1)]


def as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))
