"""Histogram boosting with second-order gain on all rows: trees for whether, and how much, a SKU sells.

Features are cut into bins at weighted quantiles; rows become blocks of small integers, written once. A level of a tree
is one Spark job: tasks add the gradients and second derivatives of their blocks per (node, feature, bin), the sums are
merged in groups of at most ``FAN_IN`` partial sums, and the best split of each node comes from the merged sums. The
driver sees one candidate split per node and group of features, and the trees. No row, sample or histogram comes to it.

Splits gain ``score(left) + score(right) - score(node)`` with ``score = shrink(G)^2 / (H + l2)``, ``shrink`` taking
``l1`` off; a child needs a weight ``H`` of ``min_child``. Null and NaN features lie below every value. Rows with a null
label teach nothing. Validation rows only decide when to stop; without them all rounds run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.session import materialize

#: Points of a quantile summary, partial sums merged by one task, bytes of a group of histograms, rounds between writes.
POINTS = 1024
FAN_IN = 64
HISTOGRAM = 1 << 20
REWRITE = 8

_NODES = "tree int, node int, feature string, threshold double, value double, gain double"


@dataclass(frozen=True)
class Settings:
    """``objective``: "logistic" (label 0 or 1) or "squared"."""

    objective: str
    rounds: int = 800
    depth: int = 7
    step: float = 0.04
    rows: float = 0.8  # share of the rows a tree learns from
    per_tree: float = 0.6  # share of the features of a tree, and of these per level
    per_level: float = 0.8
    min_child: float = 15.0
    l1: float = 0.5
    l2: float = 3.0
    min_gain: float = 0.1
    patience: int = 50
    bins: int = 64
    seed: int = 42


# Settings of the published models.
CLASSIFIER = Settings("logistic", depth=7, min_child=15.0, min_gain=0.1)
REGRESSOR = Settings("squared", depth=6, min_child=10.0, min_gain=0.05)


@dataclass
class Tree:
    """Heap of nodes; ``feature`` is -1 where a node is a leaf. A row goes left if its bin is at most ``bin``."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def reach(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after ``levels`` steps; ``bins``: (features, rows)."""
        node, at = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(levels):
            f = self.feature[node]
            inner = f >= 0
            right = bins[np.where(inner, f, 0), at] > self.bin[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node


@dataclass
class Model:
    """``cuts[f]`` are the ascending cut points of feature f; trees add up to a margin over ``base``."""

    features: list[str]
    objective: str
    base: float
    step: float
    depth: int
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def gains(self, spark: SparkSession, k: int = 15) -> DataFrame:
        """(feature, gain): the total gain of the splits on a feature, largest first."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += float(g)
        used = [(f, g) for f, g in total.items() if g > 0]
        return spark.createDataFrame(used, "feature string, gain double").orderBy(F.desc("gain"), "feature").limit(k)

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """Add ``out``: the probability, or the value, of each row."""
        names, model = self.features, self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _binned([batch.column(batch.schema.get_field_index(f)) for f in names], model.cuts)
                margin = _margins(model.trees, model.depth, model.step, bins, np.full(batch.num_rows, model.base))
                value = _sigmoid(margin) if model.objective == "logistic" else margin
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, out])

        as_double = rows.withColumns({f: F.col(f).cast("double") for f in names})
        schema = as_double.select("*", F.lit(0.0).alias(out)).schema
        return as_double.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per node and one head row per feature's cut points."""
        nodes = [
            (t, n, self.features[f] if f >= 0 else None, float(self._threshold(f, b)) if f >= 0 else None, float(v), float(g))
            for t, tree in enumerate(self.trees)
            for n, (f, b, v, g) in enumerate(zip(tree.feature, tree.bin, tree.value, tree.gain, strict=True))
            if f >= 0 or v != 0.0
        ]
        spark.createDataFrame(nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        head = [(i, f, c.tolist(), self.objective, self.base, self.step, self.depth, len(self.trees)) for i, (f, c) in enumerate(zip(self.features, self.cuts, strict=True))]
        schema = "place int, feature string, cuts array<double>, objective string, base double, step double, depth int, trees int"
        spark.createDataFrame(head, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    def _threshold(self, f: int, b: int) -> float:
        return self.cuts[f][b - 1] if b else -math.inf

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        head = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        first, place = head[0], {r["feature"]: r["place"] for r in head}
        cuts = [np.array(r["cuts"], float) for r in head]
        trees = [Tree.empty(first["depth"]) for _ in range(first["trees"])]
        for r in spark.read.parquet(f"{path}/nodes").collect():
            tree, n = trees[r["tree"]], r["node"]
            tree.value[n], tree.gain[n] = r["value"], r["gain"]
            if r["feature"] is not None:
                f = tree.feature[n] = place[r["feature"]]
                tree.bin[n] = 0 if r["threshold"] == -math.inf else 1 + int(np.searchsorted(cuts[f], r["threshold"]))
        return cls([r["feature"] for r in head], first["objective"], first["base"], first["step"], first["depth"], cuts, trees)


# ------------------------------------------------------------------------ bins


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN


def _summary(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` of the values, each standing for the weight up to it."""
    kept = ~np.isnan(values) & (weights > 0)
    distinct, where = np.unique(values[kept], return_inverse=True)
    upto = np.cumsum(np.bincount(where, weights=weights[kept], minlength=len(distinct)))
    if len(distinct) > points:
        asked = upto[-1] * np.arange(1, points + 1) / points
        chosen = np.unique(np.minimum(np.searchsorted(upto, asked * (1 - 1e-12)), len(distinct) - 1))
        distinct, upto = distinct[chosen], upto[chosen]
    return distinct, np.diff(upto, prepend=0.0)


def quantile_cuts(rows: DataFrame, features: Sequence[str], weight: str, bins: int) -> list[np.ndarray]:
    """Ascending cut points per feature, at most ``bins - 2``, at even steps of the weight.

    Partitions write summaries of ``POINTS`` values per feature, which are merged ``FAN_IN`` at a time.
    """
    names = list(features)
    schema = "part long, feature int, points binary, weights binary"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))] * len(names)
        part = None
        for batch in batches:
            if batch.num_rows:
                part, w = batch.column(0)[0].as_py(), _numbers(batch.column(1))
                for i in range(len(names)):
                    points, weights = np.concatenate([kept[i][0], _numbers(batch.column(i + 2))]), np.concatenate([kept[i][1], w])
                    kept[i] = _summary(points, weights, POINTS)
        if part is not None:
            yield pa.RecordBatch.from_pydict(
                {"part": [part] * len(names), "feature": pa.array(range(len(names)), pa.int32()), "points": [k[0].tobytes() for k in kept], "weights": [k[1].tobytes() for k in kept]}
            )

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        both = [np.concatenate([np.frombuffer(b.as_py()) for b in table[c]]) for c in ("points", "weights")]
        points, weights = _summary(*both, POINTS)
        return pa.table({"part": [table["part"][0].as_py() // FAN_IN], "feature": table["feature"][:1], "points": [points.tobytes()], "weights": [weights.tobytes()]})

    source = rows.select(F.spark_partition_id().cast("long").alias("part"), F.col(weight).cast("double"), *[F.col(f).cast("double") for f in names])
    sums = source.mapInArrow(summarise, schema)
    for _ in range(3):  # 64^3 partitions
        sums = sums.withColumn("to", F.expr(f"part div {FAN_IN}")).groupBy("feature", "to").applyInArrow(_without("to", merge), schema)
    sums = sums.withColumn("to", F.lit(0)).groupBy("feature").applyInArrow(_without("to", merge), schema)
    cuts = [np.zeros(0)] * len(names)
    for r in sums.collect():
        points, weights = np.frombuffer(r["points"]), np.frombuffer(r["weights"])
        if len(points) > 1:
            if len(points) <= bins - 1:
                cuts[r["feature"]] = points[1:].copy()
            else:
                upto = np.cumsum(weights)
                asked = upto[-1] * np.arange(1, bins - 1) / (bins - 1)
                cuts[r["feature"]] = np.unique(points[np.minimum(np.searchsorted(upto, asked) + 1, len(points) - 1)])
    return cuts


def _without(column: str, run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    return lambda table: run(table.drop_columns([column]))


def _binned(columns: list[pa.Array], cuts: list[np.ndarray]) -> np.ndarray:
    """(features, rows) bin numbers: 0 for null and NaN, else 1 and the number of cuts not above the value."""
    out = np.zeros((len(columns), len(columns[0]) if columns else 0), np.uint8)
    for i, column in enumerate(columns):
        v = _numbers(column)
        out[i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(cuts[i], v, side="right"))
    return out


_BLOCK = "n int, bins binary, label binary, weight binary, valid binary, margin binary"


def _blocks(rows: DataFrame, features: list[str], label: str, weight: str, valid: str | None, cuts: list[np.ndarray], base: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                bins = _binned(batch.columns[3:], cuts)
                y, w, v = (_numbers(batch.column(i)) for i in range(3))
                packed = [bins, y, w, v.astype(np.uint8), np.full(n, base)]
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32())} | {c: [p.tobytes()] for c, p in zip(("bins", "label", "weight", "valid", "margin"), packed, strict=True)})

    is_valid = F.coalesce(F.col(valid).cast("double"), F.lit(0.0)) if valid else F.lit(0.0)
    source = rows.select(F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), is_valid.alias("v"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return source.mapInArrow(run, _BLOCK)


def _unpack(batch: pa.RecordBatch, i: int, n_features: int):
    n = batch.column(0)[i].as_py()
    raw = [batch.column(c)[i].as_py() for c in range(1, 6)]
    bins = np.frombuffer(raw[0], np.uint8).reshape(n_features, n)
    return bins, np.frombuffer(raw[1]), np.frombuffer(raw[2]), np.frombuffer(raw[3], np.uint8).astype(bool), np.frombuffer(raw[4])


# ----------------------------------------------------------------------- trees


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def _margins(trees: Sequence[Tree], depth: int, step: float, bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for tree in trees:
        margin = margin + step * tree.value[tree.reach(bins, depth)]
    return margin


def _slopes(objective: str, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "squared":
        return w * (margin - y), w
    p = _sigmoid(margin)
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


def _loss(objective: str, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return (margin - y) ** 2 if objective == "squared" else np.logaddexp(0.0, margin) - y * margin


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return _shrunk(g, s.l1) ** 2 / np.maximum(h + s.l2, 1e-12)


def best_splits(sums: np.ndarray, s: Settings) -> list[tuple[int, int, int, float, float, float, float, float]]:
    """``sums``: (features, nodes, bins, 2). Per node: (node, feature, bin, gain, G left, H left, G, H) of the best split.

    A node without an allowed split has bin -1. Ties go to the first feature, then the lowest bin.
    """
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    gain = _score(left[..., 0], left[..., 1], s) + _score(right[..., 0], right[..., 1], s) - _score(whole[..., 0], whole[..., 1], s)
    allowed = (left[..., 1] >= s.min_child) & (right[..., 1] >= s.min_child) & (gain > s.min_gain)
    gain = np.where(allowed, gain, -np.inf)
    out = []
    for node in range(sums.shape[1]):
        f, b = np.unravel_index(int(np.argmax(gain[:, node, :])), gain[:, node, :].shape)
        found = np.isfinite(gain[f, node, b])
        g, h = (float(whole[f, node, 0, i]) for i in (0, 1))
        out.append((node, int(f), int(b) if found else -1, float(gain[f, node, b]) if found else 0.0, *(float(left[f, node, b, i]) for i in (0, 1)), g, h))
    return out


_SPLITS = "node int, feature int, bin int, gain double, left_g double, left_h double, g double, h double"


def _level(blocks: DataFrame, parts: int, s: Settings, n_features: int, fresh: list[Tree], round_: int, tree: Tree, level: int, open_: list[int], used: list[int]) -> list:
    """Best split per open node among the features ``used``; at the root also the validation loss so far."""
    slots = np.full(len(tree.feature), -1, np.int64)
    slots[open_] = np.arange(len(open_))
    nodes, bins_ = len(open_), s.bins
    each = max(1, HISTOGRAM // (nodes * bins_ * 16))
    groups = [used[i : i + each] for i in range(0, len(used), each)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, losses, part = np.zeros((len(used), nodes * bins_, 2)), np.zeros(2), None
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(6)[i].as_py()
                bins, y, w, valid, margin = _unpack(batch, i, n_features)
                margin = _margins(fresh, s.depth, s.step, bins, margin)
                if level == 0:
                    losses += _loss(s.objective, y[valid], margin[valid]).sum(), valid.sum()
                slot = slots[tree.reach(bins, level)]
                # the draw depends on the block's rows alone, so every level and every rerun sees the same rows
                draw = np.random.default_rng([s.seed, round_, len(y), int(bins.sum(dtype=np.int64))]).random(len(y))
                rows = np.flatnonzero((slot >= 0) & ~valid & (draw < s.rows))
                g, h = (x[rows] for x in _slopes(s.objective, y, w, margin))
                at = slot[rows] * bins_
                for k, f in enumerate(used):
                    place = at + bins[f, rows]
                    sums[k, :, 0] += np.bincount(place, weights=g, minlength=nodes * bins_)
                    sums[k, :, 1] += np.bincount(place, weights=h, minlength=nodes * bins_)
        if part is not None:
            blobs = [sums[i * each : (i + 1) * each].tobytes() for i in range(len(groups))] + ([losses.tobytes()] if level == 0 else [])
            ids = list(range(len(groups))) + ([-1] if level == 0 else [])
            yield pa.RecordBatch.from_pydict({"part": [part] * len(ids), "grp": pa.array(ids, pa.int32()), "sums": blobs})

    def total(table: pa.Table) -> np.ndarray:
        out = None
        for blob in table.sort_by("part")["sums"]:
            one = np.frombuffer(blob.as_py())
            out = one.copy() if out is None else out + one
        return out

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"part": [table["part"][0].as_py() // FAN_IN], "grp": table["grp"][:1], "sums": [total(table).tobytes()]})

    def choose(table: pa.Table) -> pa.Table:
        grp, sums = table["grp"][0].as_py(), total(table)
        if grp < 0:
            found = [(-1, 0, 0, float(sums[0]), float(sums[1]), 0.0, 0.0, 0.0)]
        else:
            found = best_splits(sums.reshape(len(groups[grp]), nodes, bins_, 2), s)
            found = [(n, groups[grp][f], *rest) for n, f, *rest in found]
        types = [pa.int32()] * 3 + [pa.float64()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[c.split()[0] for c in _SPLITS.split(", ")])

    sums = blocks.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(add, "part long, grp int, sums binary")
    width = parts
    while width > FAN_IN:
        sums = sums.withColumn("to", F.expr(f"part div {FAN_IN}")).groupBy("grp", "to").applyInArrow(_without("to", merge), "part long, grp int, sums binary")
        width = -(-width // FAN_IN)
    return sums.groupBy("grp").applyInArrow(choose, _SPLITS).collect()


def fit(rows: DataFrame, features: Sequence[str], label: str, settings: Settings, weight: str | None = None, valid: str | None = None) -> Model:
    """Boost trees on every row of ``rows``; those where ``valid`` is true stop the training, and do not teach.

    With no row to learn from the model is the constant 0.5, or 0. At most ``settings.bins`` <= 256 bins a feature.
    """
    if not 3 <= settings.bins <= 256:
        raise ValueError(f"3 to 256 bins, not {settings.bins}")
    s, names = settings, list(features)
    rows = rows.withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0)).where(F.col(label).isNotNull() & (F.col("_w") > 0))
    learn = rows.where(~F.coalesce(F.col(valid).cast("boolean"), F.lit(False))) if valid else rows
    mean = learn.agg((F.sum(F.col(label) * F.col("_w")) / F.sum("_w")).alias("m")).first()["m"]
    if s.objective == "logistic":
        p = min(max(0.5 if mean is None else mean, 1e-6), 1 - 1e-6)
        base = math.log(p / (1 - p))
    else:
        base = float(mean or 0.0)
    if mean is None:
        return Model(names, s.objective, base, s.step, s.depth, [np.zeros(0)] * len(names))
    model = Model(names, s.objective, base, s.step, s.depth, quantile_cuts(learn, names, "_w", s.bins))
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = _blocks(rows, names, label, "_w", valid, model.cuts, base).repartition(tasks)  # blocks are even, files of rows are not
    blocks = materialize(packed, "boosting-blocks")
    parts = blocks.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] + 1
    draw = np.random.default_rng(s.seed)
    best, written = (math.inf, 0), 0
    for round_ in range(s.rounds):
        if round_ - written >= REWRITE:
            blocks, written = materialize(_moved(blocks, model, model.trees[written:], len(names)), "boosting-blocks"), round_
        tree, open_ = Tree.empty(s.depth), [0]
        of_tree = draw.choice(len(names), max(1, round(s.per_tree * len(names))), replace=False)
        for level in range(s.depth):
            used = sorted(int(f) for f in draw.choice(of_tree, max(1, round(s.per_level * len(of_tree))), replace=False))
            found = _level(blocks, parts, s, len(names), model.trees[written:], round_, tree, level, open_, used)
            for r in found:
                if r["node"] < 0 and r["left_g"] > 0:
                    model.losses.append(r["gain"] / r["left_g"])
            open_ = _grow(tree, open_, [r for r in found if r["node"] >= 0], s, level)
            if not open_:
                break
        if model.losses:
            if model.losses[-1] < best[0]:
                best = (model.losses[-1], round_)
            elif round_ - best[1] >= s.patience:
                break
        model.trees.append(tree)
    if model.losses and len(model.trees) - best[1] > 1:
        model.trees = model.trees[: best[1]]  # the loss of a round is that of the trees before it
    return model


def _grow(tree: Tree, open_: list[int], found: list, s: Settings, level: int) -> list[int]:
    """Put the best split of each open node into the tree; the children are open below the last level."""
    following = []
    for slot, node in enumerate(open_):
        candidates = [r for r in found if r["node"] == slot]
        if level == 0 and candidates:
            tree.value[0] = _leaf(candidates[0]["g"], candidates[0]["h"], s)
        candidates = [r for r in candidates if r["bin"] >= 0]
        if candidates:
            r = min(candidates, key=lambda r: (-r["gain"], r["feature"]))
            tree.feature[node], tree.bin[node], tree.gain[node] = r["feature"], r["bin"], r["gain"]
            tree.value[2 * node + 1] = _leaf(r["left_g"], r["left_h"], s)
            tree.value[2 * node + 2] = _leaf(r["g"] - r["left_g"], r["h"] - r["left_h"], s)
            following += [2 * node + 1, 2 * node + 2]
    return following


def _leaf(g: float, h: float, s: Settings) -> float:
    return float(-_shrunk(np.array(g), s.l1) / max(h + s.l2, 1e-12))


def _moved(blocks: DataFrame, model: Model, trees: list[Tree], n_features: int) -> DataFrame:
    depth, step = model.depth, model.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for i in range(batch.num_rows):
                bins, _, _, _, margin = _unpack(batch, i, n_features)
                moved.append(_margins(trees, depth, step, bins, margin).tobytes())
            yield batch.set_column(5, "margin", pa.array(moved, pa.binary()))

    return blocks.mapInArrow(run, _BLOCK)
