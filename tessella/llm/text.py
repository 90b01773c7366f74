"""Vectorised words, word hashes and shingles over Arrow string columns.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. All kernels work on a slice of rows at a time, so that memory stays within a few
times ``SLICE_BYTES`` or the longest single text. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch: their bytes and where each text begins and ends."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Byte ranges of all words in a slice; words ``bounds[i]:bounds[i + 1]`` are of text ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        lo, hi = int(offsets[first]), int(offsets[last])
        yield Slice(first, last, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


def words(part: Slice, solid_bytes: np.ndarray | None = None) -> Words:
    """Maximal runs of solid bytes; by default, of all that are not white space."""
    n = len(part.data)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(part.last - part.first + 1, np.int64))
    solid = (~_SPACE if solid_bytes is None else solid_bytes)[part.data]
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, part.offsets))


def word_hashes(part: Slice, found: Words, lower: bool, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` folds A-Z first, ``second`` takes other constants."""
    base, inverse = (_BASE2, _INVERSE2) if second else (_BASE, _INVERSE)
    n = len(part.data)
    data = LOWER[part.data] if lower else part.data
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=sums[1:])
    raw = (sums[found.ends] - sums[found.starts]) * _powers(inverse, n + 1)[found.starts]
    return mix64(raw + (found.ends - found.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def owners(found: Words) -> np.ndarray:
    """The text each word is of, as its place in the slice."""
    return np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words at every place, over the ends of texts too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * 0xFF51AFD7ED558CCD % (1 << 64)
    return mix64(total)


def shingle_sets(part: Slice, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``k``-word shingles; a shorter text is one shingle as a whole."""
    found = words(part)
    hashes = word_hashes(part, found, lower)
    all_windows = window_hashes(hashes, k)
    for i in range(len(found.bounds) - 1):
        lo, hi = found.bounds[i], found.bounds[i + 1]
        if hi - lo >= k:
            yield np.unique(all_windows[lo : hi - k + 1])
        elif hi > lo:
            yield mix64(window_hashes(hashes[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)
