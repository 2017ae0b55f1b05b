"""Exact top-k inner products from an impact-ordered index, score at a time.

The index of a shard holds, for every dimension, segments of vectors whose (integer) components fall into one quantised
level. For a query a segment's impact is the most it can add to a score: the query component times the upper or lower
end of the level. Segments are processed by descending impact over all dimensions, in three bands. After each band the
bound of a vector - the impacts of its segments so far plus, for the dimensions in which it was not met, the next
impact there - is compared with the exact scores of the k vectors of the highest bounds. Those that cannot reach the
least of these are out for good. Processing stops only when the vectors left are few; these possible members are
rescored exactly.

Queries are read in blocks and vectors in shards, and every (block, shard) pair is one task's work. Equal scores go to
the smaller id; since bounds are compared with ``>=``, no tie is lost.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; null ids take no part;
rows with the query's own id are left out; vectors of other lengths are padded with zeros; repeated rows are separate
candidates, and a repeated query id is one query, with the smallest of its vectors; with fewer than k others all are
returned; an empty table gives an empty result. Components must stay below 2^23 after scaling, scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.session import materialize

LEVELS = 16
SHARD = 32_768
BLOCK = 512
GROUP = 3
FEW = 256


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): usable rows with their components as integers."""
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(usable & fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


class Index:
    """Impact-ordered postings of one shard, GROUP dimensions to a posting code.

    A vector's level in a dimension says in which segment of that dimension it lies; the levels of a few dimensions are
    kept as one number, so that the gains of a whole band of segments are one table look-up per vector and group.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        n = len(vectors)
        self.ids = ids
        self.vectors = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % GROUP)))
        self.width = self.vectors.shape[1]
        order = np.argsort(self.vectors, axis=0, kind="stable")
        cuts = np.unique(np.linspace(0, n, min(levels, n) + 1).astype(np.int64))
        self.levels = len(cuts) - 1
        level = np.empty((self.width, n), dtype=np.int64)
        self.low = np.empty((self.width, self.levels), dtype=np.int64)
        self.high = np.empty_like(self.low)
        for d in range(self.width):
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = order[a:b, d]
                level[d, part] = i
                self.low[d, i], self.high[d, i] = self.vectors[part[0], d], self.vectors[part[-1], d]
        self.codes = level[0::GROUP]
        for i in range(1, GROUP):
            self.codes = self.codes * self.levels + level[i::GROUP]

    def _bound(self, members: np.ndarray | None, gain: np.ndarray) -> np.ndarray:
        """Sum over dimensions of the gain of each member's level; all vectors where ``members`` is None."""
        if np.abs(gain).max(axis=1).sum() < 1 << 30:
            gain = gain.astype(np.int32)
        tables = gain[0::GROUP]
        for i in range(1, GROUP):
            tables = (tables[:, :, None] + gain[i::GROUP, None, :]).reshape(len(tables), -1)
        total = np.zeros(len(self.ids) if members is None else len(members), dtype=gain.dtype)
        for codes, table in zip(self.codes, tables, strict=True):
            total += table[codes if members is None else codes[members]]
        return total

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with id ``own``, ties to the smaller id."""
        q = np.zeros(self.width, dtype=np.int64)
        q[: min(len(query), self.width)] = query[: self.width]
        impact = np.maximum(q[:, None] * self.low, q[:, None] * self.high)
        # in each dimension levels are met from the query's side: descending for positive components
        nearness = np.where(q[:, None] > 0, np.arange(self.levels)[::-1], np.arange(self.levels))
        order = np.lexsort((nearness.ravel(), -impact.ravel()))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        place = place.reshape(impact.shape)
        members: np.ndarray | None = None
        for stop in (len(order) // 2, len(order) * 3 // 4, len(order)):
            met = place < stop
            # what a dimension can still add to a vector that was not met there: the impact of its next segment
            rest = np.where(met, np.iinfo(np.int64).min, impact).max(axis=1)
            bound = self._bound(members, np.where(met, impact, rest[:, None]))
            if members is None:
                members = np.flatnonzero(self.ids != own)
                bound = bound[members]
            if len(members) > k:
                tops = members[np.argpartition(-bound, k)[:k]]
                members = members[bound >= (self.vectors[tops] @ q).min()]
            if len(members) <= FEW:
                break
        scores = self.vectors[members] @ q
        first = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][first], scores[first]


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
            index = Index(right["vec_id"].to_numpy()[order], _matrix(right["v"])[order])
            for own, query in zip(left["query_id"].to_numpy(), _matrix(left["q"]), strict=True):
                ids, scores = index.best(query, int(own), k)
                out += [(int(own), int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows.

    Rows are dealt to shards of about SHARD by a hash of their content and place, so equal vectors spread; the query
    set is dealt into blocks of BLOCK. A query's partial results are k per shard.
    """
    rows = materialize(integers(vectors, key, vector, scale), "vectors")
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)))
    left = queries.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)), "shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))})
    right = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
