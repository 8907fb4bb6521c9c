"""Vectorised passes over whole texts in Arrow batches.

Texts stay in the Arrow buffer as UTF-8 bytes; words get 64-bit hashes from
prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised pass takes at most, but for a longer text.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: A fixed odd multiplier scatter of the 256 byte values.
BYTE_VALUES = (np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=_U) << _U(40))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes between words where words are runs of anything but ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of words where only ASCII letters, digits and bytes of longer characters count.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64, in place of weak low bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums c with hash(i, j) = (c[j] - c[i]) / base**i for any range."""
    n = len(data)
    c = np.zeros(n + 1, _U)
    np.cumsum(BYTE_VALUES[data] * powers(n)[0][:n], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(len(c))[1][start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and int64 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_ranges(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, block by block so that memory stays level."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, "right")))
        c = prefix_hash(data[lo : ends[j - 1]])
        out[i:j] = range_hash(c, starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def hashed_words(column: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end row, word hashes, row of each word, word starts and ends, row offsets in the slice."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        own = offsets[i : j + 1] - offsets[i]
        starts, ends, rows = word_ranges(part, own, inside)
        yield i, j, word_hashes(part, starts, ends), rows, starts, ends, own


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram inside a row and the index of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = hashes[:m].copy()
    for k in range(1, n):
        h = h * _U(0x9DDFEA08EB382D69 + 2 * k) + hashes[k : m + k]
    same = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[same]), same


WORD_BYTES = ~SPACE
