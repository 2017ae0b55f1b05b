"""Substring dedup over words: a compressed FM-index per shard and matching statistics by backward search.

Repeats are sought where an anchor piece of their window repeats (see ``repeats``). The contexts of a shard, with the
anchor's word replaced by a mark of its piece, are one text, whose Burrows-Wheeler transform is stored in a wavelet
matrix: one bit vector per bit of the alphabet, with a running count per 64 bits. Streams of contexts are then searched
backwards: an interval of the suffix array is narrowed word by word, and how far a match goes that still has two places
is the matching statistic that decides which windows repeat.

A failed search proves that every window over the failing stretch is unique, so the ascending search skips them all.

Defined cases: null and empty texts have no words (digest of the empty string); texts shorter than a window keep all
words; repeated rows are repeats of each other; a text of any length is one row of one task, with memory in proportion
to it; an empty table gives an empty result. Words and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from skuflow.llm.repeats import Words, by_groups, without_repeats

WINDOW = 35
PIECE = 12
UNITS = 600_000


class BitVector:
    """Bits packed into words, with a running count of ones per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones there are before position ``i``."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Backward search over a text of symbols 0 (separators) to ``symbols - 1``."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_array(text)
        counts = np.bincount(text, minlength=symbols)
        self.less = np.cumsum(counts) - counts
        bits = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[int, BitVector, int]] = []
        left = text[self.order - 1]
        for b in reversed(range(bits)):
            bit = (left >> b) & 1
            self.levels.append((b, BitVector(bit), int(len(bit) - bit.sum())))
            left = np.concatenate([left[bit == 0], left[bit == 1]])
        every = np.arange(symbols)
        self.base = self._down(every, np.zeros(symbols, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, vector, zeros in self.levels:
            ones = vector.ones(i)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with ``symbol`` put before them."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.less[symbol] - self.base[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; separators (0) sort first and by place, so that none is equal to another."""
    stops = text == 0
    n_stops = int(stops.sum())
    rank = np.where(stops, np.cumsum(stops) - 1, text + n_stops - 1).astype(np.int64) + 1
    n, bits = len(text), int(rank.max()).bit_length()
    depth = max(1, 62 // bits)
    padded = np.concatenate([rank, np.zeros(depth, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        later = np.zeros(n, dtype=np.int64)
        later[: n - depth] = rank[depth:]
        key = (rank << 32) | later
        depth *= 2


def statistics(window: int, piece: int):
    """Index function: covered stretch around the anchor of every context."""

    def index(group: np.ndarray, weight: np.ndarray, left: np.ndarray, size: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(size)
        begin = np.cumsum(size) - size + np.arange(n)  # one separator after each context
        anchor, stop = begin + left, begin + size
        names, symbol = np.unique(content, return_inverse=True)
        text = np.zeros(len(content) + n, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[stop] = False
        text[inside] = symbol + 1
        text[anchor] = len(names) + 1 + group
        index = FMIndex(text, len(names) + 2 + int(group[-1]))
        owner = np.repeat(np.arange(n), size + 1)
        mass = np.concatenate([[0], np.cumsum(weight[owner[index.order]])])

        # contexts that occur as a whole twice need no search
        before, after = np.where(weight >= 2, left, 0), np.where(weight >= 2, size - left, 0)
        lane = np.flatnonzero(weight < 2)
        first_end = np.maximum(begin + window, anchor + piece)[lane]
        stop, anchor = stop[lane], anchor[lane]
        end, least = first_end.copy(), np.full(len(lane), -1)
        at, low, high = end - 1, np.zeros(len(lane), np.int64), np.full(len(lane), len(text))
        live = np.flatnonzero(end <= stop)
        while len(live):
            low[live], high[live] = index.extend(text[at[live]], low[live], high[live])
            good = mass[high[live]] - mass[low[live]] >= 2
            hit, miss = live[good], live[~good]
            at[hit] -= 1
            full = hit[at[hit] < end[hit] - window]
            rising, falling = full[least[full] < 0], full[least[full] >= 0]
            # ascending ends: the first repeated window is found; then descending ends from the last
            least[rising] = end[rising]
            end[rising] = stop[rising]
            settled = [falling, rising[least[rising] == stop[rising]]]
            up, down = miss[least[miss] < 0], miss[least[miss] >= 0]
            end[up] = at[up] + 1 + window
            end[down] -= 1
            settled.append(down[end[down] == least[down]])
            done = np.concatenate(settled)
            before[lane[done]], after[lane[done]] = (anchor - (least - window))[done], (end - anchor)[done]
            over = np.zeros(len(lane), dtype=bool)
            over[done] = True
            over[up[end[up] > stop[up]]] = True
            again = np.concatenate([rising, up, down])
            at[again], low[again], high[again] = end[again] - 1, 0, len(text)
            live = live[~over[live]]
        return before, after

    return index


def remove_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256: texts without the words of any repeated ``window``."""
    return without_repeats(docs, Words(window, piece), by_groups(statistics(window, piece), UNITS), key, text)
