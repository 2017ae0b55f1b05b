"""Calendar columns from a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuflow.operators.features import fourier


def calendar_columns(day: str = "day", first_day: Column | None = None) -> dict[str, Column]:
    """Weekday (Monday = 0), month, ISO week, day, quarter, flags and Fourier terms.

    ``is_month_start`` means day <= 3; the strict first and last day of the
    month are the separate columns ``is_first_of_month`` and ``is_last_of_month``.
    """
    d = F.col(day)
    dow, dom = F.weekday(d).cast("double"), F.dayofmonth(d).cast("double")
    cols = {
        "dow": dow,
        "month": F.month(d).cast("double"),
        "week": F.weekofyear(d).cast("double"),
        "dom": dom,
        "qtr": F.quarter(d).cast("double"),
        "is_wknd": (dow >= 5).cast("double"),
        "is_month_start": (dom <= 3).cast("double"),
        "is_month_end": (dom >= 28).cast("double"),
        "is_week_start": (dow == 0).cast("double"),
        "is_first_of_month": (dom == 1).cast("double"),
        "is_last_of_month": (d == F.last_day(d)).cast("double"),
    }
    if first_day is not None:
        idx = F.datediff(d, first_day).cast("double")
        cols["day_idx"] = idx
        cols["day_idx_sq"] = idx * idx / 1e6
    for name, angle, ks in (
        ("y", F.dayofyear(d) / F.lit(365.25), (1, 2, 3, 4)),
        ("w", dow / 7, (1, 2)),
        ("m", dom / 31, (1, 2)),
    ):
        for k in ks:
            cols[f"fourier_sin_{name}{k}"], cols[f"fourier_cos_{name}{k}"] = fourier(angle, k)
    return cols
