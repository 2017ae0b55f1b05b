"""Language-model scores from an Elias-Fano n-gram trie.

The model has two levels, words and their successors: p(w) = (c(w) + 1) / (N + V + 1), which keeps one share for unknown
words, and p(w | v) = (c(vw) + m p(w)) / (c(v) + m), a distribution over the vocabulary and the unknown word for every v.
A text is a beginning, its words and an end. Log probabilities are stored in steps of 1/512 (so a token is off by at
most 0.001 for each stored factor), and sums of steps are whole numbers: scores do not depend on how Spark splits.

Training counts words per block of the table, numbers them by falling frequency and hands each block the numbers and
counts of its own words. Pairs, once per block, then go to shards of contexts, where each becomes a trie: the sorted
contexts, monotone pointers to their stretches of the second level, and the successors of each context as numbers
relative to where the context before it ends, which makes the level one monotone sequence. All three are Elias-Fano
coded in one flat buffer (one row of the written model), which queries use in place: a pair is found by successor search
for its context, then for the word inside that context's stretch.

A context with many occurrences is spread over shards by successor; c(v) comes with the query, so any of them can back
off. Pairs with a share of 2**-14 of all tokens or more, of which there are 2**14 at most, are answered where the text
is, so no shard receives the documents of a pair that most documents hold.

Everything gathered (words, pairs, tries) grows with the corpus; nothing is pruned. Word tables and pairs of a block are
in one task's memory, no table is on the driver.

Defined cases: null and empty texts are the end alone; null keys are scored, and teach if asked to; repeated rows count
as often as they occur; with no teaching row every word has probability 1, which is one unknown word's; an empty table
gives an empty result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.address import GROUP, Scan, addressed, by_part, read_side, write_side
from skuflow.llm.eliasfano import EliasFano
from skuflow.llm.textscan import LOWER, mix, slices, word_hashes, words
from skuflow.session import materialize

#: Weight m of the lower order.
STRENGTH = 500.0
STEPS = 512
#: Occurrences of a context per shard it is spread over, and tokens per shard.
HOT, PER_SHARD = 1 << 19, 1 << 21
FREQUENT = 1 << 14
#: Stored bytes of the table per bucket of words.
PER_BUCKET = 16 << 20
SLICE = 1 << 20
#: Tokens after which a task merges what it holds, and distinct entries after which it sends them on.
_HELD, _MOST = 500_000, 800_000
_END, _BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFEBB9087)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, by byte planes, compressed."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        kind = np.dtype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))
        out.append(np.array([len(a), kind.itemsize], np.int64).tobytes())
        out.append(a.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    at, arrays = 8, []
    for _ in range(int(np.frombuffer(body, np.int64, 1)[0])):
        n, width = np.frombuffer(body, np.int64, 2, at).tolist()
        planes = np.frombuffer(body, np.uint8, n * width, at + 16).reshape(width, n)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}").astype(np.int64) if n else np.zeros(0, np.int64))
        at += 16 + n * width
    return arrays


def _steps(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype(np.int64)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[by], first)


class _Held:
    """Counts by key, merged now and then so that memory follows the distinct keys."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.new = self.merged = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.new += len(keys)
        if self.new > _HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = _counted(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.new, self.merged = [keys], [counts], 0, len(keys)
        return keys, counts


def _tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row with an end after each, and the row of each token."""
    raw = LOWER[raw]
    starts, ends, cuts = words(raw, bounds)
    rows = len(bounds) - 1
    hashes = np.insert(word_hashes(raw, starts, ends), cuts[1:], _END)
    return hashes, np.repeat(np.arange(rows), np.diff(cuts) + 1)


# --- words ---------------------------------------------------------------------------------------------------------


def _words(buckets: int):
    """Distinct words of an address with their number of occurrences in teaching rows, per bucket of words."""

    def dealt(part: int, held: _Held) -> Iterator[pa.RecordBatch]:
        if not held.keys:
            return
        h, c = held.merge()
        bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        h, c = h[by], c[by]
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        data = [pack(h[cuts[b] : cuts[b + 1]], c[cuts[b] : cuts[b + 1]]) for b in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = _Held(), 0
        for part, batch in by_part(batches):
            if part != at:
                yield from dealt(at, held)
                held = _Held()
            at = part
            teaches = batch.column("teaches").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, raw, bounds in slices(batch.column("text"), SLICE):
                h, row = _tokens(raw, bounds)
                held.add(*_counted(np.append(h, np.full(end - first, _BEGIN)), np.append(teaches[first:end][row], teaches[first:end])))
                if held.merged > _MOST:
                    yield from dealt(at, held)
                    held = _Held()
        yield from dealt(at, held)

    return run


def _number(buckets: int):
    """Numbers of the words of a bucket by falling count, back to the addresses that hold them; 0 for untaught words."""

    def run(table: pa.Table) -> pa.Table:
        asked = [unpack(x) for x in table["data"].to_pylist()]
        h, c = _counted(np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]))
        number = np.zeros(len(h), dtype=np.int64)
        by = np.lexsort((h, -c))
        number[by] = 1 + np.arange(len(h)) * buckets + table["bucket"][0].as_py()
        number[c == 0] = 0
        real = h != _BEGIN.astype(np.int64)
        data = []
        for own, _ in asked:
            slot = np.searchsorted(h, own)
            data.append(pack(own, number[slot], c[slot]))
        totals = [[int(c[real].sum())], [int((c[real] > 0).sum())]]
        rest = [0] * (len(data) - 1)
        return pa.table({"part": table["part"], "data": pa.array(data, pa.binary()), "n": pa.array(totals[0] + rest, pa.int64()), "v": pa.array(totals[1] + rest, pa.int64())})

    return run


@dataclass(frozen=True)
class Lexicon:
    """Words of every address of the table, and the totals N and V of the teaching rows."""

    scan: Scan
    folder: str
    n: int
    v: int

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.n + self.v + 1.0)


class _Local:
    """Words of one address: ``names`` are their numbers, sorted, each with its count; index 0 is the unknown word."""

    def __init__(self, lexicon: Lexicon, part: int):
        answers = [unpack(x) for t in read_side(lexicon.folder, part, lexicon.scan.folders, ["data"]) for x in t["data"].to_pylist()]
        self.hashes, first = np.unique(np.concatenate([a[0] for a in answers]).view(np.uint64), return_index=True)
        number, count = (np.concatenate([a[k] for a in answers])[first] for k in (1, 2))
        del answers
        self.names, first, inverse = np.unique(np.append(0, number), return_index=True, return_inverse=True)
        self.counts = np.append(0, count)[first]
        self.index = inverse[1:].astype(np.int32)
        self.begin = int(self.find(np.array([_BEGIN]))[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(hashes, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        if (self.hashes[slot] != distinct).any():
            raise RuntimeError("the table changed between two readings")
        return self.index[slot][inverse].astype(np.int64)

    def pairs(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, row) of all tokens, as indices of ``names``."""
        hashes, row = _tokens(raw, bounds)
        word = self.find(hashes)
        context = np.concatenate([[self.begin], word[:-1]])
        context[np.concatenate([[True], row[1:] != row[:-1]])] = self.begin
        return context, word, row

    def shard(self, context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
        spread = (1 + self.counts[context] // HOT).astype(np.uint64)
        share = mix(self.names[word].astype(np.uint64)) % spread
        return (mix(self.names[context].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + share) % np.uint64(shards)).astype(np.int64)


# --- pairs and tries -----------------------------------------------------------------------------------------------


def _dictionary(local: _Local, context: np.ndarray, word: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Numbers (as differences) and counts of the words in use, and the pairs as indices of them (contexts as differences)."""
    used = np.zeros(len(local.names), dtype=bool)
    used[context] = True
    used[word] = True
    place = np.cumsum(used) - 1
    return [np.diff(local.names[used], prepend=0), local.counts[used]], np.diff(place[context], prepend=0), place[word]


def _pairs(lexicon: Lexicon, shards: int):
    """Distinct pairs of the teaching rows of an address with their counts, per shard."""

    def dealt(local: _Local, held: _Held) -> Iterator[pa.RecordBatch]:
        key, count = held.merge()
        context, word = np.divmod(key, len(local.names))
        shard = local.shard(context, word, shards)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        data = []
        for s in some:
            own = by[cuts[s] : cuts[s + 1]]
            names, c, w = _dictionary(local, context[own], word[own])
            data.append(pack(*names, c, w, count[own]))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, local = _Held(), None, None
        for part, batch in by_part(batches):
            if held.keys and part != at:
                yield from dealt(local, held)
                held = _Held()
            if part != at:
                at, local = part, _Local(lexicon, part)
            taught = batch.filter(batch.column("teaches"))
            for _, _, raw, bounds in slices(taught.column("text"), SLICE):
                context, word, _ = local.pairs(raw, bounds)
                held.add(*_counted(context * len(local.names) + word, np.ones(len(word), np.int64)))
                if held.merged > _MOST:
                    yield from dealt(local, held)
                    held = _Held()
        if held.keys:
            yield from dealt(local, held)

    return run


class Trie:
    """Contexts and their successors, Elias-Fano coded in one flat buffer."""

    def __init__(self, buffer: bytes | memoryview):
        view = memoryview(buffer)
        self.contexts, at = EliasFano.view(view, 0)
        self.pointers, at = EliasFano.view(view, at)
        self.words, at = EliasFano.view(view, at)
        self.children, at = EliasFano.view(view, at)
        self.steps = np.frombuffer(view, np.uint16, self.children.n, at)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, steps: np.ndarray) -> bytes:
        """From distinct pairs of numbers, sorted."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        names, place = np.unique(word, return_inverse=True)
        # successors count on from the last one of the context before, so the level never falls
        last = place[np.append(first[1:], len(word)) - 1]
        base = np.concatenate([[0], np.cumsum(last)[:-1]])
        level = place + np.repeat(base, np.diff(np.append(first, len(word))))
        parts = [EliasFano.of(x).arrays() for x in (context[first], np.append(first, len(word)), names, level)]
        return b"".join(a.tobytes() for p in parts for a in p) + steps.astype(np.uint16).tobytes()

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the pair is there, its stored log probability in steps)."""
        zero = np.zeros(len(context), dtype=np.int64)
        c, has_context = self.contexts.successor(context, zero, zero + self.contexts.n)
        w, has_word = self.words.successor(word, zero, zero + self.words.n)
        both = np.flatnonzero(has_context & has_word)
        found, steps = np.zeros(len(context), dtype=bool), zero.copy()
        first, end = self.pointers[c[both]], self.pointers[c[both] + 1]
        base = np.zeros(len(both), dtype=np.int64)
        base[first > 0] = self.children[first[first > 0] - 1]
        place, here = self.children.successor(base + w[both], first, end)
        found[both] = here
        steps[both[here]] = self.steps[place[here]]
        return found, steps


def _build(lexicon: Lexicon, strength: float, frequent: int):
    def run(table: pa.Table) -> pa.Table:
        names, total, pairs = [], [], []
        for data in table["data"].to_pylist():
            gap, count, c, w, n = unpack(data)
            own = np.cumsum(gap)
            names.append(own)
            total.append(count)
            pairs.append((own[np.cumsum(c)], own[w], n))
        names, first = np.unique(np.concatenate(names), return_index=True)
        total = np.concatenate(total)[first]
        keys = [np.searchsorted(names, c) * len(names) + np.searchsorted(names, w) for c, w, _ in pairs]
        key, n = _counted(np.concatenate(keys), np.concatenate([p[2] for p in pairs]))
        del pairs, keys
        context, word = np.divmod(key, len(names))
        p = (n + strength * lexicon.unigram(total[word])) / (total[context] + strength)
        steps = _steps(p)
        often = np.flatnonzero(n * frequent >= lexicon.n)
        trie = Trie.build(names[context], names[word], steps)
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "trie": pa.array([trie], pa.large_binary()).cast(pa.binary()), "often": pa.array([pack(names[context[often]], names[word[often]], steps[often])])})

    return run


# --- scores --------------------------------------------------------------------------------------------------------


def _queries(lexicon: Lexicon, shards: int, strength: float, often: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Pairs of an address with the rows that hold them, per shard; and per row what needs no shard."""

    def asked(local: _Local, part: int, keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        by = np.argsort(keys, kind="stable")
        keys, rows = keys[by], rows[by]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
        times = np.diff(np.append(first, len(keys)))
        keys, rows = keys[first], rows[first]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        holders = np.diff(np.append(first, len(keys)))
        context, word = np.divmod(keys[first], len(local.names))
        shard = local.shard(context, word, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[s] : cuts[s + 1]]
            names, c, w = _dictionary(local, context[own], word[own])
            size = holders[own]
            at = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield s, part, pack(*names, c, w, size, rows[at], times[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "part", "data"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, n, local = None, 0, None

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if held:
                yield sent(list(asked(local, at, *(np.concatenate([h[k] for h in held]) for k in (0, 1)))))
            held, n = [], 0

        for part, batch in by_part(batches):
            if part != at:
                yield from flushed()
                at, local = part, _Local(lexicon, part)
                unigram = _steps(lexicon.unigram(local.counts))
                backoff = _steps(strength / (local.counts + strength))
                logs = np.log10(lexicon.unigram(local.counts))
                here = np.isin(often[0], local.names) & np.isin(often[1], local.names)
                known = np.searchsorted(local.names, often[0][here]) * len(local.names) + np.searchsorted(local.names, often[1][here])
                by = np.argsort(known)
                known, known_steps = known[by], often[2][here][by]
            keys = batch.column("key")
            numbers = batch.column("row").to_numpy()
            for first, end, raw, bounds in slices(batch.column("text"), SLICE):
                context, word, row = local.pairs(raw, bounds)
                steps = np.where((context == 0) | (word == 0), unigram[word] + np.where(context == 0, 0, backoff[context]), -1)
                pair = context * len(local.names) + word
                if len(known):
                    slot = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                    steps = np.where(known[slot] == pair, known_steps[slot], steps)
                rows = end - first
                open_ = steps < 0
                sums = np.bincount(row, weights=np.where(open_, 0, steps), minlength=rows).astype(np.int64)
                tokens = np.bincount(row, minlength=rows)
                taught = np.bincount(row, weights=local.counts[word] > 0, minlength=rows).astype(np.int64)
                base = np.bincount(row, weights=logs[word], minlength=rows)
                own = keys.slice(first, rows)
                ids = own.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
                yield sent([(-1 - abs(part) % shards, part, pack(numbers[first:end].astype(np.int64), sums, tokens, taught, base.view(np.uint64), ids, own.is_valid().to_numpy(zero_copy_only=False)))])
                if open_.any():
                    held.append((pair[open_], numbers[first:end].astype(np.int64)[row[open_]]))
                    n += len(held[-1][0])
                if n > _HELD:
                    yield from flushed()
        yield from flushed()

    return run


def _answer(lexicon: Lexicon, strength: float):
    """Sums of steps per row of each blob of queries; what was settled at the text passes through (kind 0)."""

    def run(queries: pa.Table, model: pa.Table) -> pa.Table:
        trie = Trie(model["trie"][0].as_buffer()) if model.num_rows else None
        out: list[tuple[int, int, bytes]] = []
        for shard, part, data in zip(*(queries[c].to_pylist() for c in ("shard", "part", "data")), strict=True):
            if shard < 0:
                out.append((part, 0, data))
                continue
            gap, count, c, w, size, rows, times = unpack(data)
            own, c = np.cumsum(gap), np.cumsum(c)
            found, steps = trie.find(own[c], own[w]) if trie else (np.zeros(len(c), bool), np.zeros(len(c), np.int64))
            apart = _steps(strength / (count[c] + strength)) + _steps(lexicon.unigram(count[w]))
            sums = np.bincount(rows, weights=np.repeat(np.where(found, steps, apart), size) * times).astype(np.int64)
            row = np.flatnonzero(sums)
            out.append((part, 1, pack(np.diff(row, prepend=0), sums[row])))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["part", "kind", "data"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Rows of one address from all that was found out about them."""
    total = np.zeros(GROUP, dtype=np.int64)
    settled = []
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        arrays = unpack(data)
        row, sums = (np.cumsum(arrays[0]), arrays[1]) if kind else (arrays[0], arrays[1])
        total[row] += sums
        if not kind:
            settled.append(arrays)
    row, _, tokens, taught, base, ids, valid = (np.concatenate([x[k] for x in settled]) for k in range(7))
    columns = [pa.array(ids, mask=valid == 0), pa.array(tokens), pa.array(taught), pa.array(base.view(np.float64)), pa.array(total[row] / -float(STEPS))]
    return pa.table(columns, names=["key", "n_tokens", "n_known", "base_score", "score"])


@dataclass(frozen=True)
class Model:
    """A trained model with the table it was trained on: ``tries`` has one row (shard, trie, often) per shard."""

    lexicon: Lexicon
    tries: DataFrame
    shards: int
    strength: float

    def scores(self) -> DataFrame:
        """key, n_tokens, n_known, base_score, score of every row of the table."""
        blobs = [unpack(bytes(r["often"])) for r in self.tries.select("often").collect()]  # FREQUENT pairs at most
        often = tuple(np.concatenate([np.zeros(0, np.int64), *(b[k] for b in blobs)]) for k in range(3))
        rows = self.lexicon.scan.rows.select("key", "text", "part", "row")
        sent = rows.mapInArrow(_queries(self.lexicon_for_tasks, self.shards, self.strength, often), "shard int, part long, data binary")
        answers = sent.groupBy("shard").cogroup(self.tries.select("shard", "trie").groupBy("shard")).applyInArrow(_answer(self.lexicon_for_tasks, self.strength), "part long, kind int, data binary")
        return answers.groupBy("part").applyInArrow(_merge, "key long, n_tokens long, n_known long, base_score double, score double")

    @property
    def lexicon_for_tasks(self) -> Lexicon:
        return _bare(self.lexicon)


def _bare(lexicon: Lexicon) -> Lexicon:
    """The same without the frame, which tasks cannot hold."""
    return Lexicon(Scan(None, lexicon.scan.parts, lexicon.scan.stored_bytes), lexicon.folder, lexicon.n, lexicon.v)


def train(docs: DataFrame, teaches: Column, key: str = "doc_id", text: str = "text", strength: float = STRENGTH, frequent: int = FREQUENT, per_shard: int = PER_SHARD) -> Model:
    """Model of the rows that ``teaches`` marks; the other rows of ``docs`` can be scored with it as well."""
    spark = docs.sparkSession
    scan = addressed(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches")))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), scan.stored_bytes // PER_BUCKET)
    rows = scan.rows.select("text", "teaches", "part")
    counted = rows.mapInArrow(_words(buckets), "bucket int, part long, data binary")
    numbered = counted.groupBy("bucket").applyInArrow(_number(buckets), "part long, data binary, n long, v long")
    folder = write_side(numbered, scan, "words")
    totals = spark.read.schema("n long, v long").parquet(folder).agg(F.sum("n"), F.sum("v")).first() if scan.parts else (0, 0)
    lexicon = Lexicon(scan, folder, int(totals[0] or 0), int(totals[1] or 0))
    shards = 1 + lexicon.n // per_shard
    bare = _bare(lexicon)
    pairs = rows.mapInArrow(_pairs(bare, shards), "shard int, data binary")
    tries = materialize(pairs.groupBy("shard").applyInArrow(_build(bare, strength, frequent), "shard int, trie binary, often binary"), "tries")
    return Model(lexicon, tries, shards, strength)
