"""The features of ``operators/features.py`` on a grid that holds only the days with facts.

Frames are counted in days, not in rows: a window of the last 7 days holds the facts of these days, and the days
without a row are zeros whose number is known from ``day_no``. So the features of a fact need no empty day to be made,
sorted or spilled, and rows stay as many as the facts. Values equal those of the dense grid, row for row; use these
groups where only rows with facts are returned, and the others where every day is.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from skuflow.operators import features as X
from skuflow.operators.grid import EPOCH_DAYS


def past(w: int):
    """The facts of the last ``w`` days, today excluded."""
    return Window.partitionBy("sku").orderBy("day_no").rangeBetween(-w, -1)


def _sum(c: str, w: int) -> Column:
    return F.coalesce(F.sum(F.col(c).cast("double")).over(past(w)), F.lit(0.0))


def _lag(c: str, n: int) -> Column:
    """Value ``n`` days ago: 0 on a day without facts, null before the first day."""
    day = Window.partitionBy("sku").orderBy("day_no").rangeBetween(-n, -n)
    return F.when(F.col("day_no") + F.col("_before") >= n, F.coalesce(F.max(c).over(day), F.lit(0.0)))


LAG = [lambda: {f"lag_{n}": _lag("demand", n) for n in X.LAGS}]
SAME_WEEKDAY = X.SAME_WEEKDAY


def _fact_moments() -> dict[str, Column]:
    cols: dict[str, Column] = {}
    for w in X.MEAN_WINDOWS:
        cols |= {f"_k{w}": F.count("demand").over(past(w)), f"_fact_mean{w}": F.avg("demand").over(past(w)),
                 f"_fact_var{w}": F.var_pop("demand").over(past(w))}
    return cols


def _moments() -> dict[str, Column]:
    """Moments of the facts put together with those of the empty days, which are all 0."""
    cols: dict[str, Column] = {}
    for w in X.MEAN_WINDOWS:
        n, k = X._rows_seen(w), F.col(f"_k{w}")
        mean, var = F.coalesce(f"_fact_mean{w}", F.lit(0.0)), F.coalesce(f"_fact_var{w}", F.lit(0.0))
        empty = (n - k) / n  # exactly 0 if every day has facts
        m2 = k * (var + mean * mean * empty)
        cols[f"rmean_{w}"] = X._some_past(F.when(k == n, mean).otherwise(mean * k / n))
        cols[f"rstd_{w}"] = F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(F.lit(0.0))
    return cols


MOMENTS = [_fact_moments, _moments]
SUMS = [lambda: {f"rsum_{w}": X._some_past(_sum("demand", w)) for w in X.EXTREME_WINDOWS}]
FREQUENCY = [lambda: {f"dfreq_{w}": X._some_past(_sum("has_demand", w) / X._rows_seen(w)) for w in X.FREQ_WINDOWS}]
DELIVERY_ROLLING = [
    lambda: {
        f"{name}_{w}": X._some_past(_sum({"_n": "n_deliveries", "_q": "qty_delivered"}[total], w))
        for total, (name, ws) in X.DELIVERY_WINDOWS.items()
        for w in ws
    }
]


def _extremes() -> dict[str, Column]:
    """A window with an empty day also holds a 0."""
    cols: dict[str, Column] = {}
    for w in X.EXTREME_WINDOWS:
        zero = F.when(F.count("demand").over(past(w)) < F.least(F.col("day_no") + F.col("_before"), F.lit(w)), F.lit(0.0))
        cols[f"rmax_{w}"] = F.greatest(F.max("demand").over(past(w)), zero)
        cols[f"rmin_{w}"] = F.least(F.min("demand").over(past(w)), zero)
    return cols


def _positives() -> dict[str, Column]:
    positive = F.when(F.col("demand") > 0, F.col("demand"))
    return {f"_pos{w}": F.collect_list(positive).over(past(w)) for w in X.EXTREME_WINDOWS}


EXTREMES = [_extremes]
MEDIANS = [_positives, X._medians]


def _days_since() -> dict[str, Column]:
    seen = F.when(F.col("has_demand") == 1, F.col("day_no"))

    def latest(until: int) -> Column:
        frame = Window.partitionBy("sku").orderBy("day_no").rangeBetween(Window.unboundedPreceding, until)
        return F.max(seen).over(frame)

    return {
        "days_since": F.coalesce(F.col("day_no") - 1 - latest(-2), F.lit(999)).cast("double"),
        "days_since_last": F.coalesce(F.col("day_no") - latest(-1), F.lit(999)).cast("double"),
    }


DAYS_SINCE = [_days_since]


def _epoch_sums() -> dict[str, Column]:
    """Sums with restarted powers: of the epoch before today, and of the whole epoch before."""
    today = Window.partitionBy("sku", "epoch").orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1)
    closed = Window.partitionBy("sku").orderBy("epoch").rangeBetween(-1, -1)
    cols: dict[str, Column] = {}
    for span, q in X.EWM_DECAY.items():
        value = F.col("demand") * F.pow(F.lit(1 / q), X._in_epoch())
        cols |= {f"_s{span}": F.sum(value).over(today), f"_s{span}_closed": F.sum(value).over(closed)}
    return cols


def _ewm() -> dict[str, Column]:
    cols = {}
    for span, q in X.EWM_DECAY.items():
        own = F.coalesce(f"_s{span}", F.lit(0.0)) * F.pow(F.lit(q), X._in_epoch() - 1)
        closed = F.coalesce(f"_s{span}_closed", F.lit(0.0)) * F.pow(F.lit(q), F.lit(EPOCH_DAYS - 1)) * F.pow(F.lit(q), X._in_epoch())
        weights = (1 - F.pow(F.lit(q), F.col("day_no"))) / (1 - q)
        cols[f"ewm_{span}"] = X._some_past((own + closed) / weights)
    return cols


EWM = [_epoch_sums, _ewm]
RATIOS = [X.nothing, X.nothing, X._ratios]  # with LAG, SAME_WEEKDAY, MOMENTS, EWM; needs prod_avg_demand
