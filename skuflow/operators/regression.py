"""Per-SKU regression baseline: trend with changepoints, yearly and weekly waves, holidays and five regressors.

Every SKU's series covers the same calendar, and its empty days are zeros. So all SKUs share one Gram matrix, that of
the calendar's design, and empty days add nothing to the right-hand sides: these are sums over the sparse demand rows,
which merge on the map side. One shuffle of a row of sums per SKU, then every SKU is solved with the same inverse. The
dense grid is never built. What reaches the driver is the calendar's design, one row a day.

A ridge holds changepoints, waves and holidays down; the level and the first slope are free. Predictions are floored at
zero and come apart into trend, weekly, yearly, holiday and regressor parts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions.holidays import HOLIDAY_FEATURES, holiday_features
from skuflow.operators.prefix import join_on

CHANGEPOINTS, YEARLY, WEEKLY = 12, 6, 3
#: Ridge per kind of column, in units of one day's weight; a changepoint may bend the trend least.
RIDGE = {"level": 0.0, "changepoint": 20.0, "yearly": 1.0, "weekly": 1.0, "holiday": 5.0, "regressor": 1.0}
_HOLIDAYS = [h for h in HOLIDAY_FEATURES if h.startswith("is_")]
PARTS = {"trend": ("level", "changepoint"), "weekly": ("weekly",), "yearly": ("yearly",), "holidays": ("holiday",), "regressors": ("regressor",)}


@dataclass(frozen=True)
class Design:
    """Columns of the design in order: name, kind, and the expression over a calendar row (day, t, holidays)."""

    names: list[str]
    kinds: list[str]
    columns: list[Column]

    def vector(self) -> Column:
        return F.array(*self.columns)


def design(n_days: int) -> Design:
    """Design of a calendar of ``n_days``; ``t`` counts its days from zero and is scaled to the first 80 % for bends."""
    t = F.col("t") / float(max(1, n_days - 1))
    out: list[tuple[str, str, Column]] = [("level", "level", F.lit(1.0)), ("slope", "level", t)]
    for k in range(1, CHANGEPOINTS + 1):
        out.append((f"bend_{k}", "changepoint", F.greatest(t - 0.8 * k / (CHANGEPOINTS + 1), F.lit(0.0))))
    for kind, waves, angle in (("yearly", YEARLY, F.dayofyear("day") / 365.25), ("weekly", WEEKLY, F.weekday("day") / 7.0)):
        for k in range(1, waves + 1):
            out += [(f"{kind}_{f.__name__}{k}", kind, f(2 * math.pi * k * angle)) for f in (F.sin, F.cos)]
    out += [(h, "holiday", F.coalesce(F.col(h), F.lit(0.0))) for h in _HOLIDAYS]
    flag = lambda c: c.cast("double")
    out += [
        ("day_of_week", "regressor", F.weekday("day") / 6.0 - 0.5),
        ("is_weekend", "regressor", flag(F.weekday("day") >= 5)),
        ("month", "regressor", F.month("day") / 12.0 - 0.5),
        ("is_month_start", "regressor", flag(F.day("day") == 1)),
        ("is_month_end", "regressor", flag(F.col("day") == F.last_day("day"))),
    ]
    return Design([n for n, _, _ in out], [k for _, k, _ in out], [c.cast("double") for _, _, c in out])


def calendar_design(days: DataFrame, start: Column, n_days: int) -> tuple[DataFrame, Design]:
    """(day, x): the design vector of every day of ``days``; one row a day, which bounds broadcasts of it."""
    made = design(n_days)
    rows = days.select("day").distinct().join(holiday_features(days.select("day")), "day", "left")
    return rows.withColumn("t", F.datediff("day", start)).select("day", made.vector().alias("x")), made


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)


@dataclass(frozen=True)
class Fit:
    """coefficients: (sku, beta), beta in the order of the design's names."""

    coefficients: DataFrame
    design: Design
    gram: np.ndarray


def fit(daily: DataFrame, days: DataFrame, start: Column, min_days: int = 10) -> Fit:
    """Ridge fit of every SKU with at least ``min_days`` demand days. ``daily``: sku, day, demand; one row per pair.

    Days outside ``days`` teach nothing; demand that is null counts as zero; null SKUs are a SKU of their own.
    """
    n_days = days.select("day").distinct().count()
    calendar, made = calendar_design(days, start, n_days)
    x = np.array([r["x"] for r in calendar.select("x").collect()]).reshape(-1, len(made.names))
    gram = x.T @ x
    inverse = np.linalg.pinv(gram + np.diag([RIDGE[k] for k in made.kinds]), hermitian=True)

    sold = F.coalesce("demand", F.lit(0.0))
    known = daily.join(F.broadcast(calendar), "day")  # one row per calendar day
    sums = [F.sum(sold * F.col("x")[i]).alias(f"_s{i}") for i in range(len(made.names))]
    right = known.groupBy("sku").agg(F.count_if(sold > 0).alias("_days"), *sums).where(F.col("_days") >= min_days)
    sums_of = F.array(*[f"_s{i}" for i in range(len(made.names))])
    solver = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inverse])
    beta = F.transform(solver, lambda row: _dot(row, F.col("_right")))
    return Fit(right.select("sku", sums_of.alias("_right")).select("sku", beta.alias("beta")), made, gram)


def predict(fitted: Fit, rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add yhat (floored at zero) and its parts to ``rows`` (sku, day, ...). SKUs without a fit, and days
    outside the calendar, get nulls."""
    both = join_on(rows, fitted.coefficients, ["sku"], "left").join(F.broadcast(calendar), "day", "left")

    def part(products: Column, name: str) -> Column:
        own = [i for i, k in enumerate(fitted.design.kinds) if k in PARTS[name]]  # neighbours in the design
        return F.aggregate(F.slice(products, own[0] + 1, len(own)), F.lit(0.0), lambda total, v: total + v).alias(name)

    # the products are made once a row, and each is added to the one part it belongs to
    products = F.array(F.zip_with("beta", "x", lambda p, q: p * q))
    parts = F.transform(products, lambda p: F.struct(*[part(p, name) for name in PARTS]))[0]
    parted = both.withColumn("_parts", parts).withColumns({name: F.col(f"_parts.{name}") for name in PARTS}).drop("_parts")
    total = sum((F.col(p) for p in list(PARTS)[1:]), F.col("trend"))
    return parted.withColumn("yhat", F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))).drop("beta", "x")
