"""Cube-method balanced sampling: documents of a mixture, with word and document totals held at their targets.

A source whose target is r times its size gives each document floor(r) times for sure and once more with the
fractional probability that is left. The flight phase moves those probabilities along directions in the null space of
the two constraints (sum of copies, sum of words) until they are 0 or 1; totals do not change on the way. Blocks of
documents fly side by side, each leaves at most two fractional documents, and these are gathered and fly again, until
one block of their source is left. Its last flight keeps a dozen documents back; they and the last two are the landing
problem, solved by trying all outcomes.

A document far longer than the others of its block would stay open to the end, and no landing could make up for it.
Such documents are decided before the flight, by their probability, and the others' probabilities take up the words;
an outcome they cannot take up is not drawn, unless neither can be: then the nearer one is. This holds the words, while the number of copies moves.

Defined cases: a null text has no words and size 0; a null source is a source of its own, last in order; repeated rows
are counted and decided one by one; with no words at all every target is 0; an empty table gives an empty result.
Directions are drawn from hashes of the rows, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.session import materialize

#: Weights of the sources in code point order, repeating; the most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3

BLOCK = 4000
LANDING = 12
#: A document is decided before the flight if it has more than this many times the mean words of the shorter ones.
LONG = 8
_EDGE = 1e-9


def share(sizes: Sequence[float], weights: Sequence[float], most: float) -> list[float]:
    """Targets that share out all sizes by weight; none above ``most`` times its own size, the excess shared again."""
    total, limit = float(sum(sizes)), [float(most * s) for s in sizes]
    held: set[int] = set()
    while True:
        rest = total - sum(limit[i] for i in held)
        weight = sum(w for i, w in enumerate(weights) if i not in held)
        targets = [limit[i] if i in held else rest * w / weight for i, w in enumerate(weights)]
        over = {i for i, t in enumerate(targets) if i not in held and t > limit[i]}
        if not over:
            return targets
        held |= over


def settle_long(chances: Sequence[float], sizes: Sequence[float], seed: int) -> list[float]:
    """Decide the documents far longer than the rest, longest first; the open rest makes up for their words."""
    draw = random.Random(seed)
    p, size = np.array(chances, dtype=float), np.array(sizes, dtype=float)
    order = np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    order = order[np.argsort(-size[order], kind="stable")]
    for k, i in enumerate(order):
        rest = order[k + 1 :]
        room = size[rest].sum()
        if len(rest) <= LANDING or size[i] * len(rest) <= LONG * room:
            break
        words, coin = p[rest] @ size[rest], draw.random()
        wanted = {x: words + (p[i] - x) * size[i] for x in (0.0, 1.0)}
        missed = {x: max(0.0, -w, w - room) for x, w in wanted.items()}
        x = 1.0 if (missed[1.0], coin) < (missed[0.0], p[i]) else 0.0  # what can be made up for, or comes nearer; else the coin
        held = min(max(wanted[x], 0.0), room)
        if held < words:
            p[rest] *= held / words
        elif words < room:
            p[rest] = 1.0 - (1.0 - p[rest]) * (room - held) / (room - words)
        p[i] = x
    return p.tolist()


def fly(chances: list[float], sizes: Sequence[float], seed: int, keep: int = 0) -> list[float]:
    """Flight phase over one block: at most two chances stay strictly between 0 and 1, and both sums are kept.

    The last ``keep`` open chances do not fly.
    """
    draw = random.Random(seed)
    chances = [0.0 if p <= _EDGE else 1.0 if p >= 1 - _EDGE else p for p in chances]
    flying = [i for i, p in enumerate(chances) if 0.0 < p < 1.0]
    waiting = iter(flying[: max(0, len(flying) - keep)])
    window: list[int] = []
    while True:
        while len(window) < 3 and (i := next(waiting, None)) is not None:
            window.append(i)
        s = [sizes[i] for i in window]
        if len(window) == 3:
            way = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
            if not any(way):
                way = [1.0, -1.0, 0.0]
        elif len(window) == 2 and s[0] == s[1]:
            way = [1.0, -1.0]
        else:
            return chances
        up = min(((1 - chances[i]) / u if u > 0 else chances[i] / -u) for i, u in zip(window, way, strict=True) if u)
        down = min((chances[i] / u if u > 0 else (1 - chances[i]) / -u) for i, u in zip(window, way, strict=True) if u)
        step = up if draw.random() * (up + down) < down else -down
        for i, u in zip(window, way, strict=True):
            p = chances[i] + step * u
            chances[i] = 0.0 if p <= _EDGE else 1.0 if p >= 1 - _EDGE else p
        window = [i for i in window if 0.0 < chances[i] < 1.0]


def land(chances: list[float], sizes: Sequence[float]) -> list[float]:
    """Settle the few open chances so that the word total, then the copy total, comes as near as it can."""
    out = list(chances)
    open_ = [i for i, p in enumerate(out) if 0.0 < p < 1.0]
    if open_:
        taken = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        size, chance = np.array([sizes[i] for i in open_], dtype=float), np.array([out[i] for i in open_])
        words, copies = np.abs(taken @ size - chance @ size), np.abs(taken.sum(axis=1) - chance.sum())
        for i, x in zip(open_, taken[np.lexsort((copies, np.round(words, 6)))[0]], strict=True):
            out[i] = float(x)
    return out


def _flight(table: pa.Table) -> pa.Table:
    table = table.sort_by([("h", "ascending"), ("copy", "ascending"), ("size", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
    sizes, chances = [float(s) for s in table["size"].to_pylist()], table["chance"].to_pylist()
    last = table["blocks"][0].as_py() == 1
    seed = hash((table["h"][0].as_py(), table["copy"][0].as_py(), len(sizes)))
    chances = fly(settle_long(chances, sizes, seed), sizes, seed, LANDING if last else 0)
    if last:
        chances = land(chances, sizes)
    return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chances, pa.float64()))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies taken, one row per document.

    ``row`` names a unique, sortable row key that is carried along as ``row``. Only the totals per source come to the driver: sources are a list to which people assign weights.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(key), F.col(text)).alias("h"),
        (F.col(row) if row else F.lit(0).cast("long")).alias("row"),
    )
    counted = materialize(rows.groupBy("doc_id", "source", "size", "h", "row").agg(F.count("*").alias("n")), "mix-sizes")
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    targets = share([r["source_size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    plan = [(r["source"], r["source_size"], t, -(-r["rows"] // BLOCK)) for r, t in zip(totals, targets, strict=True)]
    planned = spark.createDataFrame(plan, "p_source string, source_size long, target double, blocks long")

    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    near = F.round(ratio)
    ratio = F.when(F.abs(ratio - near) < _EDGE, near).otherwise(ratio)  # 3.0 less a rounding error is 3
    units = (
        counted.join(F.broadcast(planned), F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .withColumns({"sure": F.floor(ratio).cast("long"), "chance": ratio - F.floor(ratio)})
        .withColumn("block", F.pmod(F.xxhash64("h", "copy"), F.col("blocks")))
        .drop("p_source", "n")
    )
    most_blocks = max([1, *(p[3] for p in plan)])
    settled: list[DataFrame] = []
    while True:
        flown = materialize(units.groupBy("source", "block").applyInArrow(_flight, units.schema), "mix-flight")
        fractional = (F.col("chance") > 0) & (F.col("chance") < 1)
        if most_blocks == 1:
            settled.append(flown)
            break
        settled.append(flown.where(~fractional))
        most_blocks = -(-2 * most_blocks // BLOCK)
        # a source whose last block has landed has no open document left
        units = flown.where(fractional).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK).cast("long"))
        units = units.withColumn("block", F.pmod("block", "blocks"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("sure") + F.col("chance").cast("long")).select("doc_id", "row", "source", "size", "source_size", "target", "copies")
