"""Vectorised text primitives over whole Arrow batches.

A batch is handled as one byte array plus document offsets, in slices of bounded size, so that
the cost for each document is a few array elements and not a Python loop over its words.
Words are the maximal runs of bytes other than space and 0x09-0x0D.

Hashes are 64-bit polynomials modulo 2**64 over a random byte table, finished with a bit mixer.
They are the same in every process and on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
WORD_BASE = 0xD6E8FEB86659FD93
WORD_BASE_INV = pow(WORD_BASE, -1, 2**64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as longer slices come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U64(base))
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n+1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8)[first:last] if buffers[2] is not None and last > first else np.empty(0, np.uint8)
    return data, offsets - first


@dataclass
class Slice:
    """Documents first .. first+n-1 of a batch: their bytes and offsets from 0."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole documents in slices of at most ``limit`` bytes, or one longer document each."""
    data, offsets = utf8_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield Slice(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class PrefixHash:
    """Hash of any byte range of a slice in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[data] * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(BASE_INV, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


@dataclass
class Words:
    """Word boundaries of a slice; ``doc`` is the document's place in the slice."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # for each document, its first word; n+1 entries

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)


def words(piece: Slice) -> Words:
    solid = ~IS_SPACE[piece.data]
    n = len(solid)
    begins = np.zeros(n + 1, bool)
    begins[piece.offsets] = True  # a word never runs on into the next document
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before &= ~begins[:n]
    start = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after &= ~begins[1:]
    end = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, piece.offsets)
    return Words(start, end, np.repeat(np.arange(piece.n), np.diff(first)), first)


def word_hashes(piece: Slice, found: Words, lower: bool) -> np.ndarray:
    data = LOWER[piece.data] if lower else piece.data
    return mix(PrefixHash(data).raw(found.start, found.end) + (found.end - found.start).astype(U64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every k consecutive entries; len(hashes)-k+1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(WORD_BASE)
        out += hashes[j : j + n]
    return mix(out)


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order-dependent hash of hashes[start:end] for many ranges at once."""
    n = len(hashes)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * powers(WORD_BASE, n), out=sums[1:])
    raw = (sums[end] - sums[start]) * powers(WORD_BASE_INV, n + 1)[start]
    return mix(raw + (end - start).astype(U64))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for every i."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
