"""Grid search for blend parameters.

Parameters are whole numbers (thresholds and alphas in 1/1000, bias multipliers
and powers in 1/100), so grids have no rounding at their ends. Window totals of
a blend are linear in alpha and in the multiplier, so rows are folded to one
line per (window, SKU) first; only those lines meet thresholds and alphas, and
multipliers meet sums over lines; scores combine map-side.
Scores are compared at six decimals, ties go to the first in loop order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """start (inclusive) to stop (exclusive) by step, refined around a best value."""

    start: int
    stop: int
    step: int
    reach: int
    fine_step: int
    listed: tuple[int, ...] = ()

    def coarse(self) -> list[int]:
        return list(self.listed) or list(range(self.start, self.stop, self.step))

    def fine(self, best: int) -> list[int]:
        return list(range(max(self.start, best - self.reach), min(self.stop, best + self.reach), self.fine_step))


# The search ranges.
THRESHOLD = Axis(20, 500, 20, 40, 5)
ALPHA = Axis(0, 1050, 100, 150, 25)
MULTIPLIER = Axis(50, 200, 10, 20, 1)
EV_MULTIPLIER = Axis(30, 350, 10, 30, 2)
POWER = Axis(30, 300, 0, 30, 5, listed=(50, 75, 100, 150, 200))


def penalty(bias: Column) -> Column:
    """Three points per percent of under-forecast, or of over-forecast beyond 5 %."""
    return F.when(bias < 0, -3 * bias).otherwise(3 * F.greatest(F.lit(0.0), bias - 5))


def _ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _score(grouped, err: Column, pred: Column, actual: Column) -> DataFrame:
    return _metrics(grouped.agg(F.sum(err).alias("_e"), F.sum(pred).alias("_p"), F.sum(actual).alias("_a")))


def _metrics(sums: DataFrame) -> DataFrame:
    wape = F.col("_e") / F.col("_a") * 100
    bias = (F.col("_p") - F.col("_a")) / F.col("_a") * 100
    return sums.withColumns({"wape": wape, "bias": bias}).withColumn(
        "score", F.round(F.col("wape") + penalty(F.col("bias")), 6)
    )


def _best(scored: DataFrame, params: Sequence[str]):
    """First parameter set with the lowest score; a single row."""
    top = F.min(F.struct("score", *params, "wape", "bias"))
    return scored.agg(top.alias("b")).select("b.*").first()


def _blend(b: Column, r: Column) -> Column:
    a = F.col("alpha") / 1000.0
    return a * b + (1 - a) * r


def _multiplied(lines: DataFrame, params: Sequence[str], mults: Sequence[int]) -> DataFrame:
    """Sums of |actual - blend * mult|, of blend * mult and of actual per (params, mult).

    For one parameter set the error of a line is linear in the multiplier below and above actual / blend. So lines fold
    by the first multiplier (evenly spaced) that reaches their actual, and multipliers meet only the folded sums.
    """
    step = mults[1] - mults[0] if len(mults) > 1 else 1
    first = F.ceil((F.col("actual") / F.col("blend") * 100 - mults[0]) / step)
    reach = F.when(F.col("blend") > 0, F.greatest(F.least(first, F.lit(len(mults))), F.lit(0))).otherwise(F.lit(len(mults)))
    folded = lines.groupBy(*params, reach.cast("int").alias("_reach")).agg(F.sum("actual").alias("_a"), F.sum("blend").alias("_b"))
    met = folded.select("*", F.posexplode(_ints(mults)).alias("_no", "mult"))
    pred = F.col("_b") * (F.col("mult") / 100.0)
    gap = F.col("_a") - pred
    return met.groupBy(*params, "mult").agg(
        F.sum(F.when(F.col("_reach") > F.col("_no"), gap).otherwise(-gap)).alias("_e"), F.sum(pred).alias("_p"), F.sum("_a").alias("_a")
    )


# ---------------------------------------------------------------- threshold mode


def threshold_sums(rows: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Per (win, sku): actual over all rows, baseline and regressor over rows with p >= each threshold."""
    aggs = [F.sum("actual").alias("actual")]
    for t in thresholds:
        passed = F.col("p") >= t / 1000.0
        for c in ("base", "reg"):
            aggs.append(F.sum(F.when(passed, F.col(c)).otherwise(F.lit(0.0))).alias(f"{c}_{t}"))
    folded = rows.groupBy("win", "sku").agg(*aggs).where("actual > 0")
    per_threshold = F.array(
        *[F.struct(F.lit(t).alias("thr"), F.col(f"base_{t}").alias("b"), F.col(f"reg_{t}").alias("r")) for t in thresholds]
    )
    return folded.select("actual", F.inline(per_threshold))


def threshold_scores(rows: DataFrame, thresholds, alphas, mults) -> DataFrame:
    lines = threshold_sums(rows, thresholds).withColumn("alpha", F.explode(_ints(alphas)))
    return _metrics(_multiplied(lines.withColumn("blend", _blend(F.col("b"), F.col("r"))), ("thr", "alpha"), mults))


def _search(score_fn, axes: dict[str, Axis], spark) -> DataFrame:
    """Coarse search, then a fine one around its best; the fine result must be strictly better."""
    names = list(axes)
    best = _best(score_fn(*[axes[n].coarse() for n in names]), names)
    fine = _best(score_fn(*[axes[n].fine(best[n]) for n in names]), names)
    winner = fine if fine["score"] < best["score"] else best
    schema = ", ".join(f"{n} bigint" for n in names) + ", wape double, bias double, score double"
    return spark.createDataFrame(
        [tuple(int(winner[n]) for n in names) + (winner["wape"], winner["bias"], winner["score"])], schema
    )


def tune_threshold(rows: DataFrame) -> DataFrame:
    """Best (thr, alpha, mult) on horizon totals. ``rows``: win, sku, actual, base, reg, p."""
    axes = {"thr": THRESHOLD, "alpha": ALPHA, "mult": MULTIPLIER}
    return _search(lambda t, a, m: threshold_scores(rows, t, a, m), axes, rows.sparkSession)


# ------------------------------------------------------------- expected-value mode


def expected_value_scores(rows: DataFrame, alphas, mults, powers) -> DataFrame:
    """alpha above 1 can make a row's blend negative, and it is then floored at 0 before
    summing, so those alphas get a sum of their own per power; the others stay linear."""
    above = [a for a in alphas if a > 1000]
    aggs = [F.sum("actual").alias("actual")]
    for k in powers:
        weight = F.pow("p", F.lit(k / 100.0))
        aggs += [F.sum(weight * F.col(c)).alias(f"{c}_{k}") for c in ("base", "reg")]
        for a in above:
            blend = F.lit(a / 1000.0) * F.col("base") + F.lit(1 - a / 1000.0) * F.col("reg")
            aggs.append(F.sum(weight * F.greatest(blend, F.lit(0.0))).alias(f"floored_{k}_{a}"))
    folded = rows.groupBy("win", "sku").agg(*aggs).where("actual > 0")

    def total(k: int, a: int) -> Column:
        if a > 1000:
            return F.col(f"floored_{k}_{a}")
        return F.lit(a / 1000.0) * F.col(f"base_{k}") + F.lit(1 - a / 1000.0) * F.col(f"reg_{k}")

    blends = F.array(
        *[
            F.struct(F.lit(a).alias("alpha"), F.lit(k).alias("power"), total(k, a).alias("blend"))
            for a in alphas
            for k in powers
        ]
    )
    return _metrics(_multiplied(folded.select("actual", F.inline(blends)), ("alpha", "power"), mults))


def tune_expected_value(rows: DataFrame) -> DataFrame:
    """Best (alpha, mult, power) for p^power * blend * mult on horizon totals."""
    axes = {"alpha": ALPHA, "mult": EV_MULTIPLIER, "power": POWER}
    return _search(lambda a, m, k: expected_value_scores(rows, a, m, k), axes, rows.sparkSession)


def choose_mode(threshold: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: the mode with the lower WAPE (threshold mode on a tie) and its parameters."""
    none = F.lit(None).cast("bigint")
    both = threshold.select(
        F.lit("threshold").alias("mode"), "thr", "alpha", "mult", F.lit(100).cast("bigint").alias("power"), "wape", "bias",
        F.lit(0).alias("_o"),
    ).unionByName(
        expected.select(
            F.lit("expected_value").alias("mode"), none.alias("thr"), "alpha", "mult", "power", "wape", "bias",
            F.lit(-1).alias("_o"),
        )
    )
    first = F.min_by(F.struct("mode", "thr", "alpha", "mult", "power", "wape", "bias"), F.struct("wape", -F.col("_o")))
    return both.agg(first.alias("b")).select("b.*")


# ------------------------------------------------------------------ daily objective


def daily_scores(rows: DataFrame, thresholds, alphas, mults) -> DataFrame:
    """Daily WAPE on demand rows, blending with the weighted mean ``ewm``.

    A row's error does not depend on the threshold except for passing it or not,
    so rows fold by the number of thresholds they pass before thresholds expand.
    """
    ts = F.array(*[F.lit(t / 1000.0) for t in thresholds])
    passed = F.size(F.filter(ts, lambda t: t <= F.col("p")))
    lines = (
        rows.where("actual > 0")
        .select("actual", "base", "ewm", passed.alias("passed"))
        .withColumn("alpha", F.explode(_ints(alphas)))
        .withColumn("blend", _blend(F.col("base"), F.col("ewm")))
    )
    folded = _multiplied(lines, ("passed", "alpha"), mults).withColumnsRenamed({"_e": "err", "_p": "pred", "_a": "actual"})
    per_threshold = folded.select("*", F.posexplode(_ints(thresholds)).alias("no", "thr"))
    hit = F.col("passed") > F.col("no")
    return _score(
        per_threshold.groupBy("thr", "alpha", "mult"),
        F.when(hit, F.col("err")).otherwise(F.col("actual")),
        F.when(hit, F.col("pred")).otherwise(F.lit(0.0)),
        F.col("actual"),
    )


def tune_daily(rows: DataFrame) -> DataFrame:
    """Best (thr, alpha, mult) for the older daily objective. ``rows``: actual, base, ewm, p."""
    axes = {"thr": THRESHOLD, "alpha": ALPHA, "mult": MULTIPLIER}
    return _search(lambda t, a, m: daily_scores(rows, t, a, m), axes, rows.sparkSession)
