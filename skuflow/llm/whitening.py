"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so sums and squared deviations are exact. The covariance is never formed: each pass over
the table multiplies it by a thin block Q, as the sum over rows of y (y Q) with y the centred row. A few Lanczos steps
bound the spectrum from below; then a Chebyshev polynomial of the covariance, worked by its three-term recurrence with
one pass a degree, damps everything between that bound and the least Ritz value of the block. The filtered block is
orthonormalised (QR), a Rayleigh-Ritz step turns it into approximate eigenvectors, and this repeats until the residuals
of all wanted pairs certify them. Blocks and sums have one row per dimension; sums of tasks meet in groups of 64, so
what reaches the driver does not grow with the table.

Defined cases: vectors that are null or hold null or non-finite entries are left out, and so are vectors of another
length than the commonest one (of those, the longest) and empty ones; null keys stay; repeated rows count as often as
they occur; entries beyond 2**40 are clipped there; directions without variance (below 1e-12 of the largest) are no
components, so a table of equal vectors, and an empty one, gives no rows; a deviation that exceeds a long is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.session import materialize

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
#: Residuals relative to the largest eigenvalue: aimed at, and accepted where rounding stops the descent.
CERTIFIED, ACCEPTED = 1e-13, 1e-11
DEGREE, LANCZOS, ROUNDS = 12, 12, 60
_FAN_IN = 64
_CHUNK = 1 << 20
_CLIP = float(1 << 40)


def whole_vectors(column: pa.Array, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-number matrix) of the usable vectors of a column, by length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    stops = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[stops] == bad[stops - sizes])
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        step = max(1, _CHUNK // size)
        for first in range(0, len(rows), step):
            own = rows[first : first + step]
            at = (stops - sizes)[own][:, None] + np.arange(size)
            yield own, np.floor(np.clip(scale * values[at], -_CLIP, _CLIP)).astype(np.int64) + shift


def _pack(scale: float, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for rows, x in whole_vectors(batch.column("vector"), scale, shift):
                narrow = np.int32 if np.abs(x).max() < 1 << 31 else np.int64
                columns = [pa.array([x.shape[1]], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([keys.take(pa.array(rows)).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype(narrow).tobytes()]), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["size", "n", "ids", "data", "sums"])

    return run


@dataclass(frozen=True)
class Centre:
    """Exact mean: sums = whole * n + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def rows(self, data: bytes, n: int) -> np.ndarray:
        """Whole numbers, still without the rest."""
        size = len(self.whole)
        return np.frombuffer(data, np.int32 if len(data) == 4 * n * size else np.int64).reshape(n, size).astype(np.int64) - self.whole

    def centred(self, data: bytes, n: int) -> np.ndarray:
        return self.rows(data, n) - self.rest / self.n


def _summed(packed: DataFrame, centre: Centre, shape: tuple[int, ...], step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``step`` (centred rows -> array of ``shape``) over all blocks of rows: per task, then in groups of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(shape), False
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                total += step(centre.centred(data, n))
                met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()])], names=["part", "data"])

    def added(rows: list[tuple[int, bytes]]) -> np.ndarray:
        return sum((np.frombuffer(d).reshape(shape) for _, d in sorted(rows)), np.zeros(shape))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = added(list(zip(table["part"].to_pylist(), table["data"].to_pylist(), strict=True)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([total.tobytes()])})

    sums = packed.select("n", "data").mapInArrow(run, "part long, data binary")
    parts = packed.rdd.getNumPartitions()
    while parts > _FAN_IN:
        sums = sums.groupBy(F.floor(F.col("part") / _FAN_IN).alias("g")).applyInArrow(merge, "part long, data binary")
        parts = -(-parts // _FAN_IN)
    return added([(r["part"], bytes(r["data"])) for r in sums.collect()])


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenpairs of the covariance, by falling eigenvalue, with the residual that certifies them."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def leading(size: int, wanted: int, multiply: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, eigenvectors and largest relative residual of the ``wanted`` leading pairs of a symmetric operator
    without negative eigenvalues, which is only known by its products with blocks."""
    draw = np.random.default_rng(11)
    wide = min(size, wanted + max(8, wanted // 2))
    q = np.linalg.qr(draw.standard_normal((size, wide)))[0] if wide < size else np.eye(size)

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = multiply(q)
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        return values, q, w, np.linalg.norm(w[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / max(values[0], 1e-300)

    values, q, w, residual = ritz(q)
    if wide == size or values[0] <= 0:
        return values[:wanted], q[:, :wanted], residual
    least = _lower_bound(size, multiply, draw)
    for _ in range(ROUNDS):
        if residual <= CERTIFIED:
            break
        high, top = max(values[-1], 1e-12 * values[0]), values[0]
        low = least if least < 0.999 * high else 0.0
        half, middle = (high - low) / 2, (high + low) / 2
        # a degree that lifts the largest eigenvalue by no more than 1e10, so that the others keep their digits
        degree = int(np.clip(23 / math.acosh((top - middle) / half), 2, DEGREE)) if top > high else 2
        first = half / max(top - middle, half)
        sigma, old, new = first, q, (w - middle * q) * (first / half)
        for _ in range(1, degree):
            after = 1 / (2 / first - sigma)
            old, new = new, (multiply(new) - middle * new) * (2 * after / half) - (sigma * after) * old
            sigma = after
        before = residual
        values, q, w, residual = ritz(np.linalg.qr(new)[0])
        if residual <= ACCEPTED and residual > before / 2:
            break
    else:
        raise ArithmeticError(f"eigenpairs are not certified after {ROUNDS} rounds: residual {residual:.1e}")
    return values[:wanted], q[:, :wanted], residual


def _lower_bound(size: int, multiply: Callable[[np.ndarray], np.ndarray], draw: np.random.Generator) -> float:
    """Lower end of the spectrum by Lanczos steps, less the residual of the least Ritz value."""
    basis = [draw.standard_normal(size)]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(min(size, LANCZOS)):
        w = multiply(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for b in basis * 2:  # twice is enough to stay orthogonal
            w = w - (w @ b) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    values, turn = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    return max(0.0, float(values[0] - beta[-1] * abs(turn[-1, 0])))


class Whitening:
    """A fitted transformation; its packed rows lie in the shared folder."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT):
        chosen = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        packed = materialize(chosen.mapInArrow(_pack(scale, shift), "size int, n long, ids array<long>, data binary, sums array<long>"), "vectors")
        sizes = packed.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
        self.spectrum: Spectrum | None = None
        self.spark = vectors.sparkSession
        if not sizes:
            return
        size, n = sizes[0]["size"], sizes[0]["n"]
        self.packed = packed.where(F.col("size") == size)
        totals = self.packed.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
        sums = [divmod(int(r["s"]), n) for r in sorted(totals, key=lambda r: r["pos"])]
        centre = Centre(n, np.array([w for w, _ in sums], np.int64), np.array([r for _, r in sums], np.int64))
        trace = float(_summed(self.packed, centre, (size,), lambda y: (y * y).sum(axis=0)).sum() / n)
        passes = 0

        def multiply(block: np.ndarray) -> np.ndarray:
            nonlocal passes
            passes += 1
            return _summed(self.packed, centre, block.shape, lambda y: y.T @ (y @ block)) / n

        if trace > 0:
            values, basis, residual = leading(size, min(components, size), multiply)
            real = values > 1e-12 * values[0]
            self.spectrum = Spectrum(centre, values[real], basis[:, real], trace, residual, passes)

    def identity_error(self) -> float:
        """Largest absolute entry of the whitened rows' covariance minus the identity."""
        s = self.spectrum
        map_ = s.vectors / np.sqrt(s.values)
        k, n = len(s.values), s.centre.n
        mean = _summed(self.packed, s.centre, (k,), lambda y: (y @ map_).sum(axis=0)) / n

        def products(y: np.ndarray) -> np.ndarray:
            w = y @ map_ - mean
            return w.T @ w

        return float(np.abs(_summed(self.packed, s.centre, (k, k), products) / n - np.eye(k)).max())

    def rows(self) -> DataFrame:
        """key, component, n, deviation, whitened, explained, identity_error of every remaining row and component."""
        schema = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        s = self.spectrum
        if s is None:
            return self.spark.createDataFrame([], schema)
        centre, k, error = s.centre, len(s.values), self.identity_error()
        map_, explained = s.vectors / np.sqrt(s.values), s.values / s.trace

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, ids, data in zip(batch.column("n").to_pylist(), batch.column("ids"), batch.column("data").to_pylist(), strict=True):
                    for first in range(0, n, 4096):
                        own = slice(first, first + 4096)
                        x = centre.rows(data, n)[own]
                        w = ((x - centre.rest / centre.n) @ map_).ravel()
                        key = ids.values.slice(first, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                        constant = [np.full(len(w), centre.n), np.full(len(w), error)]
                        columns = [key, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(constant[0]), _deviations(x, centre).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w), pa.array(np.tile(explained, len(x))), pa.array(constant[1])]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return self.packed.select("n", "ids", "data").mapInArrow(run, schema)


def _deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """Sum over dimensions of (n * x - sum)^2 in whole numbers; null beyond a long."""
    most = (int(np.abs(x).max()) + 1) * centre.n
    if most * most * x.shape[1] < 1 << 62:
        z = centre.n * x - centre.rest
        return pa.array((z * z).sum(axis=1))
    z = centre.n * x.astype(object) - centre.rest.astype(object)
    return pa.array([int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)], pa.int64())
