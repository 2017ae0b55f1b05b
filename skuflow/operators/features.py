"""Time-series features per SKU.

A feature group is a list of steps; each step gives new columns and may use the
columns of earlier steps. ``add`` runs the steps of all wanted groups side by
side, so that windows of the same step share one operator: the full feature set
needs four window operators over one shuffle (of the sparse rows, before the
grid is filled) and one sort, however many columns it has.

Every frame ends at the previous day: the current day never leaks into its own
features.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.operators.grid import EPOCH_DAYS, by_sku_day

LAGS = (1, 2, 3, 7, 14, 21, 28)
MEAN_WINDOWS = (3, 7, 14, 28, 60)
EXTREME_WINDOWS = (7, 14, 28)
FREQ_WINDOWS = (7, 14, 28, 60)
DELIVERY_WINDOWS = {"_n": ("del_rolling", (7, 14, 28)), "_q": ("del_qty_rolling", (7, 28))}
EPS = 1e-6

Step = Callable[[], dict[str, Column]]


def add(grid: DataFrame, *groups: list[Step]) -> DataFrame:
    """Add feature groups; columns whose name starts with an underscore are helpers and dropped."""
    for level in range(max(len(g) for g in groups)):
        cols: dict[str, Column] = {}
        for g in groups:
            if level < len(g):
                cols |= g[level]()
        grid = grid.withColumns(cols) if cols else grid
    return grid.drop(*[c for c in grid.columns if c.startswith("_")])


def nothing() -> dict[str, Column]:
    return {}


def past(w: int):
    return by_sku_day().rowsBetween(-w, -1)


def _lag(c: Column | str, n: int) -> Column:
    return F.lag(c, n).over(by_sku_day())


# ---------------------------------------------------------------------- lags

LAG = [lambda: {f"lag_{n}": _lag("demand", n) for n in LAGS}]


def _same_weekday() -> dict[str, Column]:
    """Weekly lags and the mean of the last four same weekdays (missing counts as 0)."""
    total = sum((F.coalesce(F.col(f"lag_{n}"), F.lit(0.0)) for n in (14, 21, 28)), F.coalesce("lag_7", F.lit(0.0)))
    return {"lag_w1": F.col("lag_7"), "lag_w2": F.col("lag_14"), "lag_w4": F.col("lag_28"), "rmean_wday4": total / 4}


SAME_WEEKDAY = [nothing, _same_weekday]  # with LAG


# ------------------------------------------------------- sums, means, deviations


def _rows_seen(w: int) -> Column:
    return F.least(F.col("day_no"), F.lit(w))


def _some_past(c: Column) -> Column:
    return F.when(F.col("day_no") > 0, c)


# Windows are put together from shorter ones that lie side by side, as lengths a
# and b give a + b. Nothing older than the window enters, so neither long
# histories nor level shifts cost digits, and a 60-day window costs few lags.


def _side_by_side(*lengths: int) -> Step:
    """Step that adds mean and squared deviations of the window made of ``lengths``, latest first.

    A length is 1 or that of a window of an earlier step.
    """

    def step() -> dict[str, Column]:
        first, total = F.col(f"_mean{lengths[0]}"), lengths[0]
        parts = [(_rows_seen(total), first, F.col(f"_m2_{total}"))]
        for b in lengths[1:]:
            mean_b = _lag("demand", total + 1) if b == 1 else _lag(f"_mean{b}", total)
            m2_b = F.lit(0.0) if b == 1 else _lag(f"_m2_{b}", total)
            n_b = F.greatest(F.least(F.col("day_no") - total, F.lit(b)), F.lit(0))
            parts.append((n_b, F.coalesce(mean_b, first), F.coalesce(m2_b, F.lit(0.0))))
            total += b
        # relative to the first mean, so that equal values leave exactly nothing
        shift = sum((n * (m - first) for n, m, _ in parts[1:]), F.lit(0.0)) / _rows_seen(total)
        m2 = sum((m2 + n * (m - first - shift) * (m - first - shift) for n, m, m2 in parts), F.lit(0.0))
        return {f"_mean{total}": first + shift, f"_m2_{total}": m2}

    return step


def _short_moments() -> dict[str, Column]:
    """Moments of the shortest windows, by sliding frames."""
    cols: dict[str, Column] = {}
    for w in (3, 7):
        cols[f"_mean{w}"] = F.avg("demand").over(past(w))
        cols[f"_m2_{w}"] = F.var_pop("demand").over(past(w)) * _rows_seen(w)
    return cols


def _moments() -> dict[str, Column]:
    """Mean and sample deviation (0 below two values) per window."""
    cols: dict[str, Column] = {}
    for w in MEAN_WINDOWS:
        n = _rows_seen(w)
        cols[f"rmean_{w}"] = _some_past(F.col(f"_mean{w}"))
        cols[f"rstd_{w}"] = F.when(n > 1, F.sqrt(F.col(f"_m2_{w}") / (n - 1))).otherwise(F.lit(0.0))
    return cols


def _seven(**values: str) -> Step:
    """Step of seven-day sums, by sliding frames."""
    return lambda: {f"{name}7": F.sum(F.col(c).cast("double")).over(past(7)) for name, c in values.items()}


def _twice(w: int, *names: str) -> Step:
    """Step of sums over ``w`` days from those of the two halves; days before the first count nothing."""
    return lambda: {f"{n}{w}": F.col(f"{n}{w // 2}") + F.coalesce(_lag(f"{n}{w // 2}", w // 2), F.lit(0.0)) for n in names}


def _parts_of_60() -> list[Column]:
    return [*(_lag("_h14", k) for k in (14, 28, 42)), *(_lag("has_demand", k) for k in (57, 58, 59, 60))]


MOMENTS = [
    _short_moments,
    _side_by_side(7, 7),
    lambda: _side_by_side(14, 14)() | _side_by_side(14, 14, 14, 14, 3, 1)(),
    _moments,
]
SUMS = [
    _seven(_y="demand"),
    _twice(14, "_y"),
    _twice(28, "_y"),
    lambda: {f"rsum_{w}": _some_past(F.col(f"_y{w}")) for w in EXTREME_WINDOWS},
]
FREQUENCY = [
    _seven(_h="has_demand"),
    _twice(14, "_h"),
    lambda: _twice(28, "_h")() | {"_h60": sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in _parts_of_60()), F.col("_h14"))},
    lambda: {f"dfreq_{w}": _some_past(F.col(f"_h{w}") / _rows_seen(w)) for w in FREQ_WINDOWS},
]
DELIVERY_ROLLING = [
    _seven(_n="n_deliveries", _q="qty_delivered"),
    _twice(14, "_n", "_q"),
    _twice(28, "_n", "_q"),
    lambda: {f"{name}_{w}": _some_past(F.col(f"{total}{w}")) for total, (name, ws) in DELIVERY_WINDOWS.items() for w in ws},
]


# --------------------------------------------------------- extremes and medians


def _doubled(w: int) -> dict[str, Column]:
    """Extremes of a window from those of its two halves."""
    h = w // 2
    return {
        f"rmax_{w}": F.greatest(f"rmax_{h}", _lag(f"rmax_{h}", h)),
        f"rmin_{w}": F.least(f"rmin_{h}", _lag(f"rmin_{h}", h)),
    }


# only the 7-day frame slides: 7 + 7 = 14, 14 + 14 = 28
EXTREMES = [
    lambda: {"rmax_7": F.max("demand").over(past(7)), "rmin_7": F.min("demand").over(past(7))},
    lambda: _doubled(14),
    lambda: _doubled(28),
]


def _positives() -> dict[str, Column]:
    positive = F.when(F.col("demand") > 0, F.col("demand"))
    return {f"_pos{w}": F.collect_list(positive).over(past(w)) for w in EXTREME_WINDOWS}


def _medians() -> dict[str, Column]:
    """Median per window of a non-negative series that is mostly 0.

    Only the positive values of a window are gathered (at most 28); the zeros are
    known by their number. Where zeros hold the middle, nothing is sorted.
    """
    cols = {}
    for w in EXTREME_WINDOWS:
        n = _rows_seen(w)
        zeros = n - F.size(f"_pos{w}")
        ordered = F.sort_array(f"_pos{w}")

        def at(k: Column) -> Column:
            return F.when(k < zeros, F.lit(0.0)).otherwise(F.get(ordered, k - zeros))

        low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
        cols[f"rmed_{w}"] = F.when(n > 0, F.when(high < zeros, F.lit(0.0)).otherwise((at(low) + at(high)) / 2))
    return cols


MEDIANS = [_positives, _medians]


# ------------------------------------------------------------- recency, weights


def _days_since() -> dict[str, Column]:
    """``days_since`` counts from the day after the last demand seen two or more
    days ago (the published definition); ``days_since_last`` is the plain gap.
    Both are 999 before any demand."""
    seen = F.when(F.col("has_demand") == 1, F.col("day_no"))

    def latest(until: int) -> Column:
        return F.last(seen, ignorenulls=True).over(by_sku_day().rowsBetween(Window.unboundedPreceding, until))

    return {
        "days_since": F.coalesce(F.col("day_no") - 1 - latest(-2), F.lit(999)).cast("double"),
        "days_since_last": F.coalesce(F.col("day_no") - latest(-1), F.lit(999)).cast("double"),
    }


DAYS_SINCE = [_days_since]

EWM_DECAY = {span: 1 - 2 / (span + 1) for span in (7, 28)}


def _in_epoch() -> Column:
    return F.col("day_no") - F.col("epoch") * EPOCH_DAYS


def _epoch_sums() -> dict[str, Column]:
    """Weighted sum inside the epoch, today included."""
    local = Window.partitionBy("sku", "epoch").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return {
        f"_s{span}": F.sum(F.col("demand") * F.pow(F.lit(1 / q), _in_epoch())).over(local) * F.pow(F.lit(q), _in_epoch())
        for span, q in EWM_DECAY.items()
    }


def _epoch_carry() -> dict[str, Column]:
    closing = F.col("day_no") % EPOCH_DAYS == EPOCH_DAYS - 1
    upto_yesterday = by_sku_day().rowsBetween(Window.unboundedPreceding, -1)
    cols = {}
    for span in EWM_DECAY:
        cols[f"_s{span}_closed"] = F.last(F.when(closing, F.col(f"_s{span}")), ignorenulls=True).over(upto_yesterday)
        cols[f"_s{span}_yesterday"] = F.when(_in_epoch() > 0, _lag(f"_s{span}", 1))
    return cols


def _ewm() -> dict[str, Column]:
    cols = {}
    for span, q in EWM_DECAY.items():
        # the closed epoch's sum stands at its last day; by yesterday it has decayed by q^in_epoch
        closed = F.coalesce(f"_s{span}_closed", F.lit(0.0)) * F.pow(F.lit(q), _in_epoch())
        weighted = F.coalesce(f"_s{span}_yesterday", F.lit(0.0)) + closed
        weights = (1 - F.pow(F.lit(q), F.col("day_no"))) / (1 - q)
        cols[f"ewm_{span}"] = _some_past(weighted / weights)
    return cols


# Bias-adjusted exponentially weighted mean of all earlier days. With
# q = 1 - 2/(span+1) the weighted sum is a prefix sum of y * q^-i, rescaled by
# q^i. Powers restart in each epoch so that they cannot overflow; the last closed
# epoch is carried in with its decay. What lies two epochs back weighs at most
# q^1024 (1e-31 for span 28), below the resolution of a double.
EWM = [_epoch_sums, _epoch_carry, _ewm]


# -------------------------------------------------------------- derived columns


def _ratios() -> dict[str, Column]:
    mean = F.col("prod_avg_demand") + EPS
    return {
        "cv_28": F.col("rstd_28") / (F.col("rmean_28") + EPS),
        "lag1_norm": F.col("lag_1") / mean,
        "rmean7_norm": F.col("rmean_7") / mean,
        "rmean28_norm": F.col("rmean_28") / mean,
        "ewm7_norm": F.col("ewm_7") / mean,
        "ewm28_norm": F.col("ewm_28") / mean,
        "rmean7_over_28": F.col("rmean_7") / (F.col("rmean_28") + EPS),
        "rmean_wday4_norm": F.col("rmean_wday4") / mean,
    }


RATIOS = [*[nothing] * len(MOMENTS), _ratios]  # with LAG, SAME_WEEKDAY, MOMENTS, EWM; needs prod_avg_demand


def _residuals() -> dict[str, Column]:
    residual = F.col("demand") - F.col("base_yhat")
    return {"base_resid_lag1": _lag(residual, 1), "base_resid_rmean7": F.avg(residual).over(past(7))}


def _baseline_ratios() -> dict[str, Column]:
    mean = F.col("prod_avg_demand") + EPS
    return {
        "base_ratio": F.col("base_yhat") / mean,
        "base_over_ewm7": F.col("base_yhat") / (F.col("ewm_7") + EPS),
        "base_over_rmean7": F.col("base_yhat") / (F.col("rmean_7") + EPS),
        "base_trend_norm": F.col("base_trend") / (mean + EPS),
        "base_weekly_abs": F.abs("base_weekly"),
        "base_yearly_abs": F.abs("base_yearly"),
        "base_seasonal_str": F.abs("base_weekly") + F.abs("base_yearly"),
    }


BASELINE = [_residuals, *[nothing] * (len(MOMENTS) - 1), _baseline_ratios]  # with MOMENTS, EWM; needs the base_ columns

HF_INTERACTIONS = {
    "hf_x_ramadan": "is_ramadan",
    "hf_x_eid_fitr": "is_eid_fitr",
    "hf_x_eid_adha": "is_eid_adha",
    "hf_x_ramadan_prep": "ramadan_prep",
    "hf_x_dow": "dow",
    "hf_x_month": "month",
    "hf_x_is_wknd": "is_wknd",
    "hf_x_lag1": "lag_1",
    "hf_x_rmean7": "rmean_7",
    "hf_x_base": "base_yhat",
    "hf_x_dfreq7": "dfreq_7",
    "hf_x_days_since": "days_since",
}


def hf_interactions(grid: DataFrame) -> DataFrame:
    """High-frequency flag times a feature (missing feature counts as 0)."""
    have = {n: c for n, c in HF_INTERACTIONS.items() if c in grid.columns}
    return grid.withColumns({n: F.col("is_hf") * F.coalesce(F.col(c), F.lit(0.0)) for n, c in have.items()})


def category_codes(products: DataFrame) -> DataFrame:
    """(category, cat_enc): rank in sorted order, missing category as "UNKNOWN".

    Ranks run over the distinct values only.
    """
    from skuflow.operators.prefix import numbered

    distinct = products.select(F.coalesce("category", F.lit("UNKNOWN")).alias("category")).distinct()
    return numbered(distinct, [], ["category"], "_n").select(
        "category", (F.col("_n") - 1).cast("double").alias("cat_enc")
    )


def fourier(angle: Column, k: int) -> tuple[Column, Column]:
    turn = F.lit(2 * math.pi * k) * angle
    return F.sin(turn), F.cos(turn)
