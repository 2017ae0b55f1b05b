"""SimHash fingerprints of word shingles, and their near pairs by a self-join of the binary trie.

The join walks pairs of trie nodes of equal depth together, adds up the bits in which their paths differ, and drops a
pair as soon as that exceeds the budget. The top levels of the walk are a shuffle key: every fingerprint goes to the
node pairs its leading bits can take part in, and each task walks its pairs level by level with numpy. A task returns a
spanning forest of the links it found, at most one row per fingerprint it holds, so dense groups stay linear.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated texts share a
fingerprint, which enters the join once; repeated rows are kept; an empty table gives an empty result; a text may have
any length, its shingles are counted in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from skuflow.llm.components import components
from skuflow.llm.textscan import slices
from skuflow.session import materialize

#: Fixed value: the seed of XXH64.
SEED = 42

NODE = 512
_PIECE = 1 << 16
_FRONT = 1 << 18
_LEAF = 48


def fingerprint(text: bytes, width: int) -> int:
    """64 majority bits over the hashes of all shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, n, _PIECE):
        part = words[first : min(n, first + _PIECE) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(part) >= width else [b" ".join(part)]
        digests = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(SEED))), dtype=np.uint8)
        ones += np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, raw, bounds in slices(batch.column("text"), 1 << 22):
                data = raw.tobytes()
                out += [fingerprint(data[bounds[i] : bounds[i + 1]], width) for i in range(end - first)]
            prints = pa.array(np.array(out, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), prints], names=["doc_id", "row", "print"])

    return run


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, row, print): the fingerprint of every document as a signed long; ``row`` keeps its type."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), (F.lit(0).cast("long") if row is None else row).alias("row"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints(width), f"doc_id long, row {narrow.schema['row'].dataType.simpleString()}, print long")


def near_pairs(points: np.ndarray, left: np.ndarray, right: np.ndarray, spent: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``points`` that differ in at most ``budget`` bits.

    ``left`` and ``right`` hold ranges [low, high) of ``points``, each sorted and distinct, whose members agree on the
    first ``depth`` bits; ``spent`` counts the bits in which the two paths differ. Equal ranges are joined with
    themselves. Work is taken from a stack in blocks, so memory is bounded however dense the links are.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, left.astype(np.int64), right.astype(np.int64), spent.astype(np.int64))]
    while stack:
        depth, left, right, spent = stack.pop()
        if len(left) > _FRONT:
            half = len(left) // 2
            stack += [(depth, left[:half], right[:half], spent[:half]), (depth, left[half:], right[half:], spent[half:])]
            continue
        n_left, n_right = left[:, 1] - left[:, 0], right[:, 1] - right[:, 0]
        small = (n_left * n_right <= _LEAF) | (depth == 64)
        if small.any():
            yield from _leaves(points, left[small], right[small], budget)
            left, right, spent = left[~small], right[~small], spent[~small]
        if not len(left):
            continue
        if depth not in ones:
            ones[depth] = np.zeros(len(points) + 1, dtype=np.int32)
            np.cumsum((points >> np.uint64(63 - depth)) & np.uint64(1), out=ones[depth][1:])
        count = ones[depth]
        middle = [side[:, 1] - (count[side[:, 1]] - count[side[:, 0]]) for side in (left, right)]
        zero = [np.stack([side[:, 0], m], axis=1) for side, m in zip((left, right), middle, strict=True)]
        one = [np.stack([m, side[:, 1]], axis=1) for side, m in zip((left, right), middle, strict=True)]
        same = (left == right).all(axis=1)
        parts = [(zero[0], zero[1], spent), (one[0], one[1], spent), (zero[0], one[1], spent + 1), (one[0][~same], zero[1][~same], spent[~same] + 1)]
        lefts, rights, costs = (np.concatenate(x) for x in zip(*parts, strict=True))
        alive = (costs <= budget) & (lefts[:, 0] < lefts[:, 1]) & (rights[:, 0] < rights[:, 1])
        stack.append((depth + 1, lefts[alive], rights[alive], costs[alive]))


def _leaves(points: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n_right = right[:, 1] - right[:, 0]
    sizes = (left[:, 1] - left[:, 0]) * n_right
    for first in range(0, len(sizes), _FRONT // 8):
        s, w = sizes[first : first + _FRONT // 8], n_right[first : first + _FRONT // 8]
        pair = np.repeat(np.arange(first, first + len(s)), s)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(s) - s, s)
        wide = np.repeat(w, s)
        i, j = left[pair, 0] + place // wide, right[pair, 0] + place % wide
        near = (np.bitwise_count(points[i] ^ points[j]) <= budget) & (i != j)
        if near.any():
            yield i[near], j[near]


class Forest:
    """Union of links by smallest label, kept as one label per node."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.label[a], self.label[b]
            open_ = a != b
            if not open_.any():
                return
            a, b = np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_])
            np.minimum.at(self.label, a, b)
            while (deeper := self.label[self.label] != self.label).any():
                self.label[deeper] = self.label[self.label[deeper]]


def _join(depth: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not sum(b.num_rows for b in tables):
            return
        table = pa.Table.from_batches(tables)
        points = table["print"].to_numpy().view(np.uint64)
        low, high, side = (table[c].to_numpy().astype(np.int64) for c in ("low", "high", "side"))
        order = np.lexsort((points, side, high, low))
        points, low, high, side = points[order], low[order], high[order], side[order]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (side[1:] != side[:-1])]))
        bounds = np.stack([new, np.append(new[1:], len(points))], axis=1)
        low, high, side = low[new], high[new], side[new]
        selfs = np.flatnonzero(low == high)
        firsts = np.flatnonzero((low[:-1] == low[1:]) & (high[:-1] == high[1:]) & (side[:-1] == 0) & (side[1:] == 1))
        lefts, rights = np.concatenate([selfs, firsts]), np.concatenate([selfs, firsts + 1])
        spent = np.bitwise_count((low ^ high)[lefts].astype(np.uint64)).astype(np.int64)
        distinct, node = np.unique(points, return_inverse=True)
        forest = Forest(len(distinct))
        for i, j in near_pairs(points, bounds[lefts], bounds[rights], spent, depth, budget):
            forest.add(node[i], node[j])
        member = np.flatnonzero(forest.label != np.arange(len(distinct)))
        signed = distinct.view(np.int64)
        for first in range(0, len(member), 100_000):
            part = member[first : first + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(signed[part]), pa.array(signed[forest.label[part]])], names=["a", "b"])

    return run


def trie_links(prints: DataFrame, budget: int) -> DataFrame:
    """(a, b): links that connect all distinct ``print`` values at most ``budget`` bits apart, as spanning forests."""
    n = prints.count()
    depth = max(1, min(24, (max(1, n) // NODE).bit_length()))
    flips = [0, *[1 << i for i in range(depth)]] if budget else [0]
    for _ in range(2, budget + 1):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(depth)} | set(flips))
    path = F.shiftrightunsigned(F.col("print"), 64 - depth)
    dealt = (
        prints.select("print", path.alias("path"), F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"))
        .withColumn("other", F.col("path").bitwiseXOR(F.col("flip")))
        .select("print", F.least("path", "other").alias("low"), F.greatest("path", "other").alias("high"), (F.col("path") > F.col("other")).cast("int").alias("side"))
    )
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(flips) // 1_000_000)
    return dealt.repartition(tasks, "low", "high").mapInArrow(_join(depth, budget), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, key: str = "doc_id", text: str = "text", row: Column | None = None, group_by_row: bool = False) -> DataFrame:
    """doc_id, row, fingerprint (16 hex digits), component_id (smallest key of the group), one row per document.

    With ``group_by_row`` (and a unique ``row``) also is_first: whether the row is the one that stays, which is that of
    the group with the smallest key, null keys last, then the smallest row.
    """
    prints = materialize(fingerprints(docs, width, key, text, row), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = materialize(prints.groupBy("print").agg(F.min(place).alias("least")), "classes")
    links = materialize(trie_links(classes.select("print"), budget), "links")
    roots = components(links)
    joined = classes.join(roots, classes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    joined = materialize(joined, "roots")
    groups = joined.groupBy("root").agg(F.min("least").alias("first"))
    named = joined.join(groups, "root").select(F.col("print").alias("p"), "first")
    first = [(F.col("row") == F.col("first.row")).alias("is_first")] if group_by_row else []
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(named, prints["print"] == named["p"]).select("doc_id", "row", hexed.alias("fingerprint"), F.col("first.doc_id").alias("component_id"), *first)
