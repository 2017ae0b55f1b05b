"""Repeated windows of long texts: the shared frame of the two substring operators.

A window is W consecutive units (words or bytes) of one text. It has an anchor: the first of its K-unit pieces with the
least hash, so equal windows have equal anchors at equal places. Each anchor is one narrow row with a hash of its piece
and one of its context, the stretch of text that all windows with this anchor can reach. Windows can only repeat where
the piece repeats; of such places each distinct context is fetched once, with the number of places where it occurs, and
handed to an index that reports, per context, the stretch covered by repeated windows. All of these windows hold the
anchor, so that stretch is one interval, and it is carried back to every place.

A piece with more than LARGE distinct contexts is no task's own: the windows of its contexts become rows (piece, hash of
the window and its place around the anchor), which Spark counts, and the addresses that hold such a context are told
which of its windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.address import addressed, by_part, read_side, write_side
from skuflow.llm.textscan import BYTE_VALUE, Rolling, mix, slices, word_hashes, words
from skuflow.session import materialize

SLICE = 1 << 21
BLOCK = 1 << 21
LARGE = 4096
#: Stored bytes of the table per bucket of pieces: about as many bytes of anchors.
PER_BUCKET = 24 << 20
_PLACE = np.uint64((1 << 24) - 1)  # bits of a place in a block; the same for all blocks, so that equal windows agree


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(values: np.ndarray, cuts: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row, piece hash and context hash of all anchors of a run of rows with bounds ``cuts``.

    Long runs are worked in overlapping blocks, so that memory stays small beside the values.
    """
    found = []
    for start in range(0, max(1, len(values) - window + 1), BLOCK):
        low, high = max(0, start - window), min(len(values), start + BLOCK + 2 * window)
        own = np.clip(cuts, low, high) - low
        place, piece_hash, context = _block_anchors(values[low:high], own, start - low, start - low + BLOCK, window, piece)
        found.append((place + low, piece_hash, context))
    place, piece_hash, context = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # a piece may be the anchor of windows of two blocks
        place, first = np.unique(place, return_index=True)
        piece_hash, context = piece_hash[first], context[first]
    row = np.searchsorted(cuts, place, side="right") - 1
    return row, place - cuts[row], piece_hash, context


def _block_anchors(values: np.ndarray, cuts: np.ndarray, first: int, last: int, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows that start in [first, last)."""
    sizes = np.diff(cuts)
    if not (sizes >= window).any():
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64)
    roll = Rolling(values)
    hashes = roll.fixed(piece)
    # the hash above, the place below: equal hashes go to the first place
    least = _window_minima((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), window - piece + 1)
    change = np.zeros(len(values) + 2, dtype=np.int64)
    long = sizes >= window
    np.add.at(change, cuts[:-1][long], 1)
    np.add.at(change, cuts[1:][long] - window + 1, -1)
    inside = np.cumsum(change)[: len(least)] > 0
    inside[:first] = False
    inside[last:] = False
    place = (least[inside] & _PLACE).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    row = np.searchsorted(cuts, place, side="right") - 1
    left = np.minimum(window - piece, place - cuts[row])
    right = np.minimum(window, cuts[row + 1] - place)
    context = mix(roll.of(place - left, place + right) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return place, hashes[place], context


class Unit:
    """What a window is made of. ``load`` takes a run of rows and gives the 64-bit values of its units and the row bounds
    in units; then ``pack`` gives the content of stretches, ``kept`` the bytes of a row without the units marked."""

    width = 0

    def __init__(self, window: int, piece: int):
        self.window, self.piece = window, piece

    def load(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def pack(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def kept(self, row: int, gone: np.ndarray) -> bytes:
        raise NotImplementedError


class Bytes(Unit):
    """UTF-8 bytes."""

    width = 1

    def load(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.raw, self.bounds = raw, bounds
        return BYTE_VALUE[raw], bounds

    def pack(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.raw[_stretches(low, high)]

    def kept(self, row: int, gone: np.ndarray) -> bytes:
        return self.raw[self.bounds[row] : self.bounds[row + 1]][~gone].tobytes()


class Words(Unit):
    """Runs of bytes other than white space; in contexts a word is its 64-bit hash."""

    width = 8

    def load(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.data = raw.tobytes()
        self.starts, self.ends, self.bounds = words(raw, bounds)
        self.hashes = word_hashes(raw, self.starts, self.ends)
        return self.hashes, self.bounds

    def pack(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.hashes[_stretches(low, high)]

    def kept(self, row: int, gone: np.ndarray) -> bytes:
        own = slice(self.bounds[row], self.bounds[row + 1])
        data = self.data
        return b" ".join([data[s:e] for s, e in zip(self.starts[own][~gone].tolist(), self.ends[own][~gone].tolist(), strict=True)])


def _stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sizes = high - low
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _in_order(content: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Contents of the contexts that begin there, one after the other. It is copied a block at a time, since the places of
    all units would take many times the room of the units."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=content.dtype)
    first, done = 0, 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, done + BLOCK // 4, side="right")))
        own = slice(first, last)
        out[done : ends[last - 1]] = content[_stretches(begin[own], begin[own] + size[own])]
        first, done = last, int(ends[last - 1])
    return out


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _merge(m: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (piece, context) pairs of a task, and whether each was met more than once."""
    if not m:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool)
    m, c = np.concatenate(m), np.concatenate(c)
    order = np.lexsort((c, m))
    m, c = m[order], c[order]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])])
    first = np.flatnonzero(new)
    return m[first], c[first], np.diff(np.append(first, len(m))) > 1


def _pieces(unit: Unit, buckets: int):
    """First pass: distinct (piece, context) pairs of an address, packed per bucket of pieces; the last bit of a context
    hash says that it was met more than once here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms: list[np.ndarray] = []
        cs: list[np.ndarray] = []
        held, at = 0, 0
        for part, batch in by_part(batches):
            if ms and (part != at or held > 4_000_000):
                yield from _dealt(at, *_merge(ms, cs), buckets)
                ms, cs, held = [], [], 0
            at = part
            for _, _, raw, bounds in slices(batch.column("text"), SLICE):
                _, _, m, c = anchors(*unit.load(raw, bounds), unit.window, unit.piece)
                ms.append(m)
                cs.append(c & ~np.uint64(1))
                held += len(m)
        yield from _dealt(at, *_merge(ms, cs), buckets)

    return run


def _dealt(part: int, m: np.ndarray, c: np.ndarray, twice: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(m):
        return
    bucket = (mix(m) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    m, c = m[order], (c | twice.astype(np.uint64))[order]
    rows = [(b, _blob(m[cuts[b] : cuts[b + 1]], c[cuts[b] : cuts[b + 1]])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "part", "data"])


def _decide(table: pa.Table, large: int) -> pa.Table:
    """Which contexts of a bucket can hold a repeated window, which address is to send each, and who waits for it.

    Kinds: 0 contexts to send (context, weight), 1 contexts whose result is awaited, 2 contexts that occur as a whole
    more than once and need no index (their result is known: all of it), as no other context has the piece or more than
    ``large`` have it, 3 contexts of such large groups (context, weight), whose windows are counted by Spark.
    """
    parts = [np.frombuffer(x.as_py(), dtype=np.uint64).reshape(2, -1) for x in table["data"]]
    sizes = [p.shape[1] for p in parts]
    both = np.concatenate(parts, axis=1)
    owner = np.repeat(table["part"].to_numpy(), sizes)
    m, c, times = both[0], both[1] & ~np.uint64(1), 1 + (both[1] & np.uint64(1)).astype(np.int64)
    order = np.lexsort((owner, c, m))
    m, c, times, owner = m[order], c[order], times[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])]))
    weight = np.minimum(np.add.reduceat(times, new), 2)
    group = np.flatnonzero(np.concatenate([[True], m[new][1:] != m[new][:-1]]))
    total, distinct = np.add.reduceat(weight, group), np.diff(np.append(group, len(new)))
    size = np.diff(np.append(new, len(m)))
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1])])
    keep = np.repeat(total >= 2, distinct)
    alone = np.repeat(distinct == 1, distinct)
    many = np.repeat(distinct > large, distinct)
    out: list[tuple[int, int, int, bytes]] = []
    bucket = table["bucket"][0].as_py()

    def send(kind: int, chosen: np.ndarray, *columns: np.ndarray) -> None:
        by = np.argsort(owner[chosen], kind="stable")
        to = owner[chosen][by]
        if not len(to):
            return
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
            out.append((bucket, int(to[a]), kind, _blob(*(x[by][a:b] for x in columns))))

    indexed = keep & ~alone & ~many
    for kind, chosen in ((0, indexed), (3, many)):
        ask = new[chosen]
        send(kind, ask, c[ask], weight[chosen].astype(np.uint64))
    wait = np.flatnonzero(np.repeat(indexed, size) & fresh)
    send(1, wait, c[wait])
    known = np.flatnonzero(np.repeat(keep & alone | many & (weight >= 2), size) & fresh)
    send(2, known, c[known])
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "part", "kind", "data"])


def _side(folder: str, part: int, folders: int) -> list[bytes]:
    return [x for t in read_side(folder, part, folders, ["data"]) for x in t["data"].to_pylist()]


def _asked(folder: str, part: int, folders: int) -> np.ndarray:
    """Contexts and weights that an address was asked for, by context."""
    blobs = _side(folder, part, folders)
    asked = np.concatenate([np.frombuffer(b, np.uint64).reshape(2, -1) for b in blobs], axis=1) if blobs else np.zeros((2, 0), np.uint64)
    return asked[:, np.argsort(asked[0])]


def _find(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``c``, position in the sorted ``keys``) of all that agree."""
    if not len(keys) or not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
    hit = np.flatnonzero(keys[slot] == c)
    return hit, slot[hit]


def _contexts(unit: Unit, buckets: int, folder: str, folders: int):
    """Second pass: the contexts this address was asked for, each once a task, packed and compressed per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part, asked, sent = None, np.zeros((2, 0), np.uint64), np.zeros(0, dtype=bool)
        squeeze = zstandard.ZstdCompressor(level=1)
        for part, batch in by_part(batches):
            if part != at_part:
                at_part, asked = part, _asked(folder, part, folders)
                sent = np.zeros(asked.shape[1], dtype=bool)
            if not len(sent):
                continue
            for _, _, raw, bounds in slices(batch.column("text"), SLICE):
                values, cuts = unit.load(raw, bounds)
                row, place, m, c = anchors(values, cuts, unit.window, unit.piece)
                hit, slot = _find(asked[0], c & ~np.uint64(1))
                _, first = np.unique(slot, return_index=True)
                hit, slot = hit[first], slot[first]
                new = ~sent[slot]
                hit, slot = hit[new], slot[new]
                sent[slot] = True
                if not len(hit):
                    continue
                bucket = (mix(m[hit]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                hit, slot, bucket = hit[order], slot[order], bucket[order]
                at = cuts[row[hit]] + place[hit]
                left = np.minimum(unit.window - unit.piece, place[hit])
                right = np.minimum(unit.window, cuts[row[hit] + 1] - at)
                low, high = at - left, at + right
                ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
                rows = []
                for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
                    own = slice(a, b)
                    head = _blob(m[hit[own]], c[hit[own]] & ~np.uint64(1), asked[1][slot[own]], left[own].astype(np.uint64), (left + right)[own].astype(np.uint64))
                    rows.append((int(bucket[a]), int(b - a), squeeze.compress(head + unit.pack(low[own], high[own]).tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "data"])

    return run


def _window_keys(unit: Unit, values: np.ndarray, cuts: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, units before it, hash) of all windows that hold one of these anchors; the hash covers both."""
    at = cuts[row] + place
    most = np.minimum(unit.window - unit.piece, place)
    least = np.maximum(0, unit.window - (cuts[row + 1] - at))
    owner = np.repeat(np.arange(len(at)), most - least + 1)
    start = _stretches(at - most, at - least + 1)
    before = at[owner] - start
    return owner, before, mix(Rolling(values).of(start, start + unit.window) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(unit: Unit, folder: str, folders: int):
    """Pass for large groups: the windows of the contexts this address was asked for. A context that occurs once is met in
    one task; one that occurs twice may be sent by two, and its windows repeat anyway.

    ``weight`` counts places up to two; ``part`` is null unless a context that occurs once here waits for the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part, asked, sent = None, np.zeros((2, 0), np.uint64), np.zeros(0, dtype=bool)
        for part, batch in by_part(batches):
            if part != at_part:
                at_part, asked = part, _asked(folder, part, folders)
                sent = np.zeros(asked.shape[1], dtype=bool)
            if not len(sent):
                continue
            for _, _, raw, bounds in slices(batch.column("text"), SLICE):
                values, cuts = unit.load(raw, bounds)
                row, place, m, c = anchors(values, cuts, unit.window, unit.piece)
                hit, slot = _find(asked[0], c & ~np.uint64(1))
                _, first = np.unique(slot, return_index=True)
                first = first[~sent[slot[first]]]
                hit, slot = hit[first], slot[first]
                sent[slot] = True
                if not len(hit):
                    continue
                owner, _, key = _window_keys(unit, values, cuts, row[hit], place[hit])
                piece, weight = m[hit][owner], asked[1][slot][owner].astype(np.int64)
                order = np.lexsort((key, piece))
                piece, key, weight = piece[order], key[order], weight[order]
                new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (key[1:] != key[:-1])]))
                waits = np.minimum.reduceat(weight, new) == 1
                arrays = [pa.array(piece[new].view(np.int64)), pa.array(key[new].view(np.int64)), pa.array(np.minimum(np.add.reduceat(weight, new), 2)), pa.array(np.full(len(new), part, np.int64), mask=~waits)]
                yield pa.RecordBatch.from_arrays(arrays, names=["piece", "key", "weight", "part"])

    return run


def _joined(piece: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(piece * np.uint64(0xD6E8FEB86659FD93) + key)


#: An index takes (group, weight, left, size, content) of contexts sorted by group and returns, per context, how many
#: units before and after the anchor are covered by repeated windows (0, 0: none).
IndexFunction = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _indexed(index: IndexFunction, dtype: type):
    def run(sent: pa.Table, waiting: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if sent.num_rows:
            heads, contents = [], []
            for n, data in zip(sent["n"].to_pylist(), sent["data"].to_pylist(), strict=True):
                body = zstandard.ZstdDecompressor().decompress(data)
                heads.append(np.frombuffer(body, np.uint64, count=5 * n).reshape(5, n))
                contents.append(np.frombuffer(body, dtype, offset=40 * n))
            m, c, weight, left, size = np.concatenate(heads, axis=1)
            content = np.concatenate(contents)
            del heads, contents
            left, size, weight = left.astype(np.int64), size.astype(np.int64), weight.astype(np.int64)
            begin = np.cumsum(size) - size
            order = np.lexsort((c, m))
            order = order[np.concatenate([[True], (c[order][1:] != c[order][:-1]) | (m[order][1:] != m[order][:-1])])]
            content = _in_order(content, begin[order], size[order])
            m, c, weight, left, size = m[order], c[order], weight[order], left[order], size[order]
            before, after = index(m, weight, left, size, content)
            del content
            by = np.argsort(c)
            keys = c[by]
            for part, data in zip(waiting["part"].to_pylist(), waiting["data"].to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint64)
                hit, slot = _find(keys, own)
                if len(hit) < len(own):
                    raise RuntimeError("the table changed between two readings")
                good = by[slot]
                found = (before[good] + after[good]) > 0
                if found.any():
                    rows.append((part, _blob(own[hit[found]], before[good][found].astype(np.uint64), after[good][found].astype(np.uint64))))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])

    return run


def by_groups(index: IndexFunction, limit: int) -> IndexFunction:
    """Run an index over runs of whole groups of about ``limit`` units, so that its memory is bounded.

    A larger group is one run; groups of more than LARGE contexts never come here.
    """

    def run(group: np.ndarray, weight: np.ndarray, left: np.ndarray, size: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        units = np.cumsum(size)
        before, after = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        first = 0
        while first < len(size):
            start = units[first] - size[first]
            i = int(np.searchsorted(units[ends - 1], start + limit, side="right"))
            end = int(ends[i - 1]) if i and ends[i - 1] > first else int(ends[np.searchsorted(ends, first, side="right")])
            own = slice(first, end)
            number = np.cumsum(np.concatenate([[0], group[own][1:] != group[own][:-1]]))
            before[own], after[own] = index(number, weight[own], left[own], size[own], content[start : units[end - 1]])
            first = end
        return before, after

    return run


def _cut(unit: Unit, folders: int, known: str, found: str, counted: str | None = None, repeated: str | None = None):
    """Third pass: what is left of every text. The last two are the contexts of large groups and their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part, results = None, np.zeros((3, 0), np.uint64)
        single, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for part, batch in by_part(batches):
            if part != at_part:
                at_part = part
                sure = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in _side(known, part, folders))])
                reach = np.full(len(sure), unit.window, np.uint64)
                results = np.concatenate([np.stack([sure, reach, reach]), *(np.frombuffer(b, np.uint64).reshape(3, -1) for b in _side(found, part, folders))], axis=1)
                results = results[:, np.argsort(results[0])]
                if counted and repeated:
                    asked = _asked(counted, part, folders)
                    single = asked[0][asked[1] == 1]
                    tables = [[t[x].to_numpy().view(np.uint64) for x in ("piece", "key")] for t in read_side(repeated, part, folders, ["piece", "key"])]
                    twice = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_joined(*t) for t in tables)]))
            for first, end, raw, bounds in slices(batch.column("text"), SLICE):
                values, cuts = unit.load(raw, bounds)
                row, place, m, c = anchors(values, cuts, unit.window, unit.piece)
                hit, slot = _find(results[0], c & ~np.uint64(1))
                at = cuts[row[hit]] + place[hit]
                # a context known as a whole is cut at the ends of its text
                low = np.maximum(at - np.minimum(results[1][slot].astype(np.int64), unit.window - unit.piece), cuts[row[hit]])
                high = np.minimum(at + results[2][slot].astype(np.int64), cuts[row[hit] + 1])
                change = np.zeros(len(values) + 1, dtype=np.int64)
                np.add.at(change, low, 1)
                np.add.at(change, high, -1)
                hit, slot = _find(single, c & ~np.uint64(1))
                if len(hit) and len(twice):
                    owner, before, key = _window_keys(unit, values, cuts, row[hit], place[hit])
                    again, _ = _find(twice, _joined(m[hit][owner], key))
                    start = (cuts[row[hit]] + place[hit])[owner[again]] - before[again]
                    np.add.at(change, start, 1)
                    np.add.at(change, start + unit.window, -1)
                gone = np.cumsum(change)[:-1] > 0
                border = np.ones(len(gone) + 1, dtype=bool)
                border[1:-1] = False
                border[cuts] = True
                opens = gone & ~np.concatenate([[False], gone[:-1]]) | gone & border[:-1]
                totals = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens)]
                removed, spans = (t[cuts[1:]] - t[cuts[:-1]] for t in totals)
                digests = [hashlib.sha256(unit.kept(i, gone[cuts[i] : cuts[i + 1]])).hexdigest() for i in range(end - first)]
                columns = [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(cuts)), pa.array(removed), pa.array(spans), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, unit: Unit, index: IndexFunction, key: str = "doc_id", text: str = "text", large: int = LARGE) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans (maximal removed runs), kept_sha256, one row per document.

    ``docs`` is read three times, a fourth time where a group has more than ``large`` contexts, and no text is shuffled:
    small packed rows go from addresses of the table to buckets of pieces and back (see ``address``), so the readings
    may be split differently. An index that misses a context it was promised fails.
    """
    spark = docs.sparkSession
    scan = addressed(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    texts = scan.rows.select("text", "part")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), scan.stored_bytes // PER_BUCKET)
    folders, dtype = scan.folders, (np.uint8 if unit.width == 1 else np.uint64)
    entries = texts.mapInArrow(_pieces(unit, buckets), "bucket int, part long, data binary")
    decided = materialize(entries.groupBy("bucket").applyInArrow(lambda t: _decide(t, large), "bucket int, part long, kind int, data binary"), "decided")

    def side(kind: int, label: str) -> str:
        return write_side(decided.where(F.col("kind") == kind).select("part", "data"), scan, label)

    asked, known = side(0, "asked"), side(2, "known")
    sent = texts.mapInArrow(_contexts(unit, buckets, asked, folders), "bucket int, n int, data binary")
    waiting = decided.where("kind = 1").select("bucket", "part", "data")
    results = sent.groupBy("bucket").cogroup(waiting.groupBy("bucket")).applyInArrow(_indexed(index, dtype), "part long, data binary")
    found = write_side(results, scan, "found")
    counted = repeated = None
    if not decided.where("kind = 3").isEmpty():
        counted = side(3, "counted")
        rows = texts.mapInArrow(_windows(unit, counted, folders), "piece long, key long, weight long, part long")
        times = rows.groupBy("piece", "key").agg(F.sum("weight").alias("times"), F.collect_set("part").alias("parts"))
        repeated = write_side(times.where("times >= 2").select("piece", "key", F.explode("parts").alias("part")), scan, "repeated")
    return scan.rows.select("doc_id", "text", "part").mapInArrow(_cut(unit, folders, known, found, counted, repeated), "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string")
