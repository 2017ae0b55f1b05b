"""Whole columns of text as numpy arrays: byte buffers, word bounds and rolling hashes, for use inside Arrow tasks.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


class Rolling:
    """Hash of any slice of a sequence of 64-bit values, from one running sum (arithmetic modulo 2^64)."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _powers(_BASE, len(values)), out=self.sums[1:])
        self.back = _powers(_BASE_INVERSE, len(values) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def fixed(self, n: int) -> np.ndarray:
        """Hashes of all slices of length ``n``."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n] + np.uint64(n))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and the row bounds (rows + 1 numbers)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, row bounds).

    Rows are never cut: a longer row is a run of its own.
    """
    raw, offsets = buffers(column)
    first = 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (rows + 1 numbers)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = SPACE[raw]
    inside = ~gap[1:-1]
    border = np.zeros(len(raw) + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (gap[:-2] | border[:-1]))
    ends = np.flatnonzero(inside & (gap[2:] | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, worked in blocks so that memory stays small beside the text."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        end = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 20), side="right")))
        low = starts[first]
        roll = Rolling(BYTE_VALUE[raw[low : ends[end - 1]]])
        out[first:end] = roll.of(starts[first:end] - low, ends[first:end] - low)
        first = end
    return out
