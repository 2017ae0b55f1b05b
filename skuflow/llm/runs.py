"""Periodic runs in the words of a text, by descending-LCP Kruskal.

The suffixes of a text are sorted by prefix doubling, and neighbours get the length of their common prefix (LCP) from
the ranks of the doubling rounds. Then suffix classes are united by decreasing LCP in a union-find whose classes keep
their positions in order. When a union at LCP l makes positions i < j neighbours and j - i is at most l, the stretch
from i to j + l has period j - i, and that is its smallest period: a smaller one would have put a position between
them into the class before. A stretch that cannot be extended to the left is a run, and each run is met exactly once.

Only words whose sequence of ``least / 2`` comes twice in a text can lie in a run, so texts without such a sequence are
not sorted, and classes whose positions are all further apart than their LCPs are not united.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; null keys and repeated rows are
rows like others; a text of any length is one row of one task, with memory in proportion to it; an empty table gives an
empty result. Words are told apart by 64-bit hashes, and every run is compared word by word; where that fails, the
texts are worked again with exact numbers for their words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.textscan import Rolling, mix, slices, word_hashes, words

LEAST = 12
SLICE = 1 << 21


def _stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sizes = high - low
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _doubled(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and after each doubling the rank of every position: the first place of its class in the order.

    ``order`` sorts ``text``; separators must be unique. Only classes of two and more are sorted again.
    """
    n = len(text)
    first = np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]]))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, size)
    levels, h = [rank], 1
    live = order[np.repeat(size > 1, size)]
    while len(live):
        key = rank[live] * (n + 1) + rank[live + h]
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old = rank[live]
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(live)))
        begin = np.repeat(group, np.diff(np.append(group, len(live))))
        rank = rank.copy()
        rank[live] = old + np.repeat(first, size) - begin
        levels.append(rank)
        live = live[np.repeat(size > 1, size)]
        h *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, levels


def _common(i: np.ndarray, j: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of two suffixes, from the ranks of all doublings."""
    length = np.zeros(len(i), dtype=np.int64)
    for k in reversed(range(len(levels))):
        same = levels[k][i + length] == levels[k][j + length]
        length += same.astype(np.int64) << k
    return length


def _unite(positions: list[int], edges: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Kruskal: (first position, distance, LCP) of neighbours whose distance is at most the LCP that united them.

    ``positions`` by place in the suffix order; an edge (place, LCP) joins a place and the next, by decreasing LCP.
    """
    parent = list(range(len(positions)))
    members = [[p] for p in positions]
    starts: list[int] = []
    gaps: list[int] = []
    lengths: list[int] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for place, lcp in edges:
        a, b = root(place), root(place + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b] = a
        last = len(small) - 1
        spots = []
        for t, x in enumerate(small):
            k = bisect_left(large, x)
            spots.append(k)
            if k and x - large[k - 1] <= lcp and (t == 0 or small[t - 1] < large[k - 1]):
                starts.append(large[k - 1])
                gaps.append(x - large[k - 1])
                lengths.append(lcp)
            if k < len(large) and large[k] - x <= lcp and (t == last or small[t + 1] > large[k]):
                starts.append(x)
                gaps.append(large[k] - x)
                lengths.append(lcp)
        if last < 8:
            for t, k in enumerate(spots):
                large.insert(k + t, small[t])
        else:
            large += small
            large.sort()
        members[b] = []
    return starts, gaps, lengths


def runs_of(ids: np.ndarray, cuts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of all runs of rows of word numbers with bounds ``cuts``, by row, start, period."""
    none = np.zeros(0, np.int64)
    floor = -(-least // 2)
    sizes = np.diff(cuts)
    if not (sizes >= least).any():
        return none, none, none, none
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grams = Rolling(mix(ids.astype(np.uint64))).fixed(floor)
    inside = owner[: len(grams)] == owner[floor - 1 :]
    tagged = (grams ^ mix(owner[: len(grams)].astype(np.uint64) + np.uint64(1)))[inside]
    by = np.argsort(tagged)
    again = np.flatnonzero(tagged[by][1:] == tagged[by][:-1])
    rows = np.unique(owner[: len(grams)][inside][by[again]])
    if not len(rows):
        return none, none, none, none

    # the chosen rows as one text, a separator of its own after each
    n_words = sizes[rows]
    stop = np.cumsum(n_words + 1) - 1
    begin = stop - n_words
    names, number = np.unique(ids[_stretches(cuts[rows], cuts[rows + 1])], return_inverse=True)
    text = np.empty(int(stop[-1]) + 1, dtype=np.int64)
    text[stop] = np.arange(len(stop))
    word = np.ones(len(text), dtype=bool)
    word[stop] = False
    text[word] = number + len(stop)
    order, levels = _doubled(text, np.argsort(text, kind="stable"))
    depth = floor.bit_length() - 1
    if len(levels) <= depth:
        return none, none, none, none
    near = np.flatnonzero(levels[depth][order[:-1]] == levels[depth][order[1:]])
    lcp = _common(order[near], order[near + 1], levels)
    near, lcp = near[lcp >= floor], lcp[lcp >= floor]
    if not len(near):
        return none, none, none, none

    # classes at the least LCP that hold two positions no further apart than their largest LCP
    head = np.concatenate([[True], near[1:] != near[:-1] + 1])
    kind = np.cumsum(head) - 1
    places = np.flatnonzero(np.bincount(np.concatenate([near, near + 1]), minlength=len(order)))
    kinds = kind[np.maximum(np.searchsorted(near, places, side="right") - 1, 0)]
    kinds = np.where(np.isin(places, near), kind[np.minimum(np.searchsorted(near, places), len(near) - 1)], kinds)
    by = np.lexsort((order[places], kinds))
    gap = np.diff(order[places][by])
    within = kinds[by][1:] == kinds[by][:-1]
    closest = np.full(int(kind[-1]) + 1, len(text), dtype=np.int64)
    np.minimum.at(closest, kinds[by][1:][within], gap[within])
    deepest = np.zeros(int(kind[-1]) + 1, dtype=np.int64)
    np.maximum.at(deepest, kind, lcp)
    useful = closest <= deepest
    keep_edge, keep_place = useful[kind], useful[kinds]
    near, lcp, places = near[keep_edge], lcp[keep_edge], places[keep_place]
    if not len(near):
        return none, none, none, none
    compact = np.searchsorted(places, near)
    by = np.argsort(-lcp, kind="stable")
    found = _unite(order[places].tolist(), list(zip(compact[by].tolist(), lcp[by].tolist(), strict=True)))
    start, period, shared = (np.array(x, dtype=np.int64) for x in found)
    ok = (text[start - 1] != text[start + period - 1]) & (period + shared >= least)
    start, period, length = start[ok], period[ok], (period + shared)[ok]
    row = np.searchsorted(stop, start)
    by = np.lexsort((period, start))
    return rows[row][by], (start - begin[row])[by], length[by], period[by]


def _same_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether all words of the runs are byte for byte those a period later."""
    i = _stretches(low, low + length - period)
    j = i + np.repeat(period, length - period)
    if ((ends - starts)[i] != (ends - starts)[j]).any():
        return False
    return bool((raw[_stretches(starts[i], ends[i])] == raw[_stretches(starts[j], ends[j])]).all())


def _numbered_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data, seen = raw.tobytes(), {}
    return np.array([seen.setdefault(data[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Kept words of each row with one space between."""
    chosen = np.flatnonzero(kept)
    counts = np.concatenate([[0], np.cumsum(kept)])
    sizes = ends[chosen] - starts[chosen] + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(bounds[-1]), 32, dtype=np.uint8)
    within = np.ones(len(out), dtype=bool)
    within[bounds[1:] - 1] = False
    out[within] = raw[_stretches(starts[chosen], ends[chosen])]
    row_bounds = bounds[counts[cuts]]
    filled = row_bounds[1:] > row_bounds[:-1]
    drop = np.ones(len(out), dtype=bool)
    drop[row_bounds[1:][filled] - 1] = False  # no space after a row's last word
    offsets = row_bounds - np.concatenate([[0], np.cumsum(filled)])
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[drop]))


def _collapse(least: int):
    kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, bounds in slices(batch.column("text"), SLICE):
                starts, ends, cuts = words(raw, bounds)
                ids = word_hashes(raw, starts, ends)
                found = runs_of(ids, cuts, least)
                if not _same_words(raw, starts, ends, cuts[found[0]] + found[1], found[2], found[3]):
                    found = runs_of(_numbered_words(raw, starts, ends), cuts, least)
                row, start, length, period = found
                change = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(change, cuts[row] + start + period, 1)
                np.add.at(change, cuts[row] + start + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                offsets = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kinds)))
                text = _joined(raw, starts, ends, cuts, kept).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, end - first), pa.array(np.diff(cuts)), runs, text], names=["key", "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period), collapsed: per text all runs of at least
    ``least`` words and two periods, and the text without what follows the first period of a run. Nothing is shuffled."""
    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(_collapse(least), f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
