"""Vectorised word hashing over Arrow string columns.

Every operator that looks inside documents uses the same definition of a word:
a maximal run of bytes above the space character (0x20), lower-cased for ASCII
and the Latin-1 letters of UTF-8, with ASCII punctuation ignored.  Words that
consist of punctuation only disappear.  All work is numpy over the raw UTF-8
buffers, so the cost is a few nanoseconds per byte and no Python object is made
per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: 0: ignored (punctuation), 1: separator, else the lower-cased byte.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:128] = 0
_CLASS[:33] = 1
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[:2] = 0
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * _CHUNK)
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of a batch: hash of each, first word of each document, byte span of each."""

    hash: np.ndarray
    first: np.ndarray  # len(docs) + 1
    start: np.ndarray  # byte offsets within ``data``
    stop: np.ndarray
    data: np.ndarray
    offset: np.ndarray  # byte offset of each document, len(docs) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offset = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offset[0] : offset[-1]], offset - offset[0]


def _chunk(data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, first byte and end of each word, and the first word of each document."""
    kind = np.take(_CLASS, data)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        after = data[lead + 1]
        kind[lead[(after <= 0x9E) & (after != 0x97)] + 1] += 32
    kept = np.flatnonzero(kind)
    kind = kind[kept]
    bound = np.searchsorted(kept, offset)
    solid = kind != 1
    edge = solid.copy()
    edge[1:] &= ~solid[:-1]
    head = bound[:-1][bound[:-1] < len(kind)]
    edge[head] = solid[head]
    start = np.flatnonzero(edge)
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offset), np.int64)
    power, inverse = _powers(len(kind))
    term = np.take(_BYTE, kind)
    term *= power[: len(kind)]
    h = np.add.reduceat(term, start)
    h *= inverse[start]
    edge = solid
    edge[:-1] &= ~solid[1:] if len(head) < 2 else ~(solid[1:] & _inside(len(solid), head)[1:])
    return mix(h), kept[start], kept[np.flatnonzero(edge)] + 1, np.searchsorted(start, bound)


def _inside(n: int, head: np.ndarray) -> np.ndarray:
    m = np.ones(n, bool)
    m[head] = False
    return m


def words(column: pa.Array) -> Words:
    """Hash every word of every document of ``column``."""
    data, offset = buffers(column)
    n = len(offset) - 1
    parts, lo, word0 = [], 0, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + _CHUNK, side="right")) - 1)
        a, b = offset[lo], offset[hi]
        h, s, e, f = _chunk(data[a:b], offset[lo : hi + 1] - a) if b > a else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(hi - lo + 1, np.int64))
        parts.append((h, s + a, e + a, f[:-1] + word0))
        word0 += len(h)
        lo = hi
    z = np.zeros(0, np.int64)
    if not parts:
        return Words(np.zeros(0, np.uint64), np.zeros(1, np.int64), z, z, data, offset)
    h, s, e, f = (np.concatenate(x) for x in zip(*parts))
    return Words(h, np.append(f, word0).astype(np.int64), s, e, data, offset)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that stay within a document, and the index of their first words."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[: len(w.hash) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : len(w.hash) - n + 1 + k]
    doc = w.doc
    ok = doc[: len(h)] == doc[n - 1 :]
    return mix(h[ok]), np.flatnonzero(ok)
