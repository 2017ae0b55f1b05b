"""Elias-Fano sequences in flat buffers: written once, then used in place without unpacking."""

from __future__ import annotations

import numpy as np


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` in each 64-bit word."""
    x, r, place = words.copy(), rank.astype(np.int64), np.zeros(len(words), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
        up = r >= count
        r = np.where(up, r - count, r)
        x = np.where(up, x >> np.uint64(width), x)
        place += width * up
    return place


class EliasFano:
    """Non-decreasing whole numbers: the low bits packed, the high parts in unary with a count of ones per 64 bits."""

    def __init__(self, n: int, bits: int, top: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.top = n, bits, top
        self.low, self.high, self.before = low, high, before
        self.zeros = 64 * np.arange(len(high), dtype=np.int64) - before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        most = int(values[-1]) if n else 0
        bits = max(0, ((most + 1) // max(n, 1)).bit_length() - 1)
        top = most >> bits
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + top + 1) // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(high, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        before = np.zeros(len(high), dtype=np.int64)
        np.cumsum(np.bitwise_count(high[:-1]), out=before[1:])
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            rest = values & np.uint64((1 << bits) - 1)
            start = np.arange(n, dtype=np.int64) * bits
            shift = (start & 63).astype(np.uint64)
            np.bitwise_or.at(low, start >> 6, rest << shift)
            over = (start & 63) + bits > 64
            np.bitwise_or.at(low, (start[over] >> 6) + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, top, low, high, before)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits, self.top, len(self.low), len(self.high)], np.int64), self.low, self.high, self.before]

    @classmethod
    def view(cls, buffer: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at byte ``at`` of a buffer, and where it ends. Nothing is copied."""
        n, bits, top, lows, highs = np.frombuffer(buffer, np.int64, 5, at).tolist()
        at += 40
        low = np.frombuffer(buffer, np.uint64, lows, at)
        high = np.frombuffer(buffer, np.uint64, highs, at + 8 * lows)
        before = np.frombuffer(buffer, np.int64, highs, at + 8 * (lows + highs))
        return cls(n, bits, top, low, high, before), at + 8 * (lows + 2 * highs)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        start = i * self.bits
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        above = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | above) & np.uint64((1 << self.bits) - 1)

    def _ones(self, i: np.ndarray) -> np.ndarray:
        """Place of one number ``i`` in the unary part."""
        word = np.searchsorted(self.before, i, side="right") - 1
        return 64 * word + _select(self.high[word], i - self.before[word])

    def _until(self, h: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below ``h``."""
        out = np.zeros(len(h), dtype=np.int64)
        some = h > 0
        z = h[some] - 1
        word = np.searchsorted(self.zeros, z, side="right") - 1
        out[some] = 64 * word + _select(~self.high[word], z - self.zeros[word]) - z
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self._ones(i) - i) << self.bits) | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the least number at or above ``x`` among the places [first, end), and whether it is ``x``."""
        high = x >> self.bits
        beyond = high > self.top
        high = np.where(beyond, self.top, high)
        low = np.maximum(first, self._until(high))
        stop = np.maximum(low, np.minimum(end, self._until(high + 1)))
        low = np.where(beyond, end, low)
        stop = np.where(beyond, end, stop)
        want = (x & ((1 << self.bits) - 1)).astype(np.uint64)
        bound = stop.copy()
        live = np.flatnonzero(low < bound)
        while len(live):
            middle = (low[live] + bound[live]) >> 1
            less = self._low(middle) < want[live]
            low[live] = np.where(less, middle + 1, low[live])
            bound[live] = np.where(less, bound[live], middle)
            live = live[low[live] < bound[live]]
        found = low < stop
        found[found] = self._low(low[found]) == want[found]
        return low, found
