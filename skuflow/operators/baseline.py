"""Per-SKU decomposable baseline: trend x weekly x yearly x holiday, by aggregation only.

Empty days have y = 0 and so add nothing to any sum of y; how many days a
weekday, month or holiday class has is a property of the calendar. The fit
therefore reads only the sparse demand rows, never the dense grid; only the
predictions are dense. All sums combine map-side, and a SKU has at most one row
per day.

Definition, per SKU over the fitted days (t = days since the first day):
trend = max(intercept + slope*t, 0.1*mean(y)) with the least-squares line;
r = y/trend; weekly = mean(r by weekday)/mean(r); yearly = mean(r/weekly by
month)/mean(r/weekly); holiday = mean(r/weekly/yearly by class)/overall mean;
an index whose denominator is 0 is 1, and a cell divided by a 0 index counts as
0. yhat = max(0, product). ``base_weekly``/``base_yearly`` hold index - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions.holidays import holiday_events
from skuflow.operators.prefix import spread

FIT_ROWS = 250_000

LEVELS = {"dow": range(7), "month": range(1, 13), "hol": range(2)}


def class_calendar(days: DataFrame, start: Column) -> DataFrame:
    """Per day: t, weekday, month, holiday class, and how many days of each class there are.

    One row per calendar day, which bounds every broadcast of it.
    """
    events = holiday_events(days.sparkSession).select(F.col("ds").alias("day")).distinct().withColumn("_h", F.lit(1))
    classed = days.join(F.broadcast(events), "day", "left").select(
        "day",
        F.datediff("day", start).cast("double").alias("t"),
        F.weekday("day").alias("dow"),
        F.month("day").alias("month"),
        F.coalesce("_h", F.lit(0)).alias("hol"),
    )
    everything = Window.partitionBy()
    return classed.withColumns(
        {
            **{f"n_{level}": F.count("day").over(Window.partitionBy(level)) for level in LEVELS},
            "n_all": F.count("day").over(everything),
            "sum_t": F.sum("t").over(everything),
            "sum_tt": F.sum(F.col("t") * F.col("t")).over(everything),
        }
    )


def fitted_dimension(daily: DataFrame, days: DataFrame, start: Column, min_days: int = 10) -> DataFrame:
    """One row per SKU with everything scoring needs.

    slope, intercept, mean_y, three maps class -> index, ``gap_index`` for classes
    without demand, cal_factor (mean demand over mean prediction on demand days,
    within 0.2..5) and simple_avg (mean demand over demand days). SKUs with fewer
    than ``min_days`` rows get only simple_avg.

    ``daily``: sparse (sku, day, demand) on the fitted days; ``days``: all fitted
    days. Every stage is a window within the SKU, so the whole fit takes one
    shuffle of the sparse rows and no join but the calendar's. That shuffle gives
    a task about FIT_ROWS rows at any size, as the windows sort them several times.
    Counts ``daily``, best a written table.
    """
    sku = Window.partitionBy("sku")
    y, t = F.col("demand"), F.col("t")
    dealt = spread(daily.select("sku", "day", "demand"), ["sku"], daily.count(), FIT_ROWS)
    rows = dealt.join(F.broadcast(class_calendar(days, start)), "day")
    rows = rows.withColumns({"sy": F.sum(y).over(sku), "sty": F.sum(t * y).over(sku)})
    denominator = F.col("n_all") * F.col("sum_tt") - F.col("sum_t") * F.col("sum_t")
    slope = F.when(
        denominator != 0, (F.col("n_all") * F.col("sty") - F.col("sum_t") * F.col("sy")) / denominator
    ).otherwise(F.lit(0.0))
    rows = rows.withColumns({"slope": slope, "mean_y": F.col("sy") / F.col("n_all")})
    rows = rows.withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("sum_t") / F.col("n_all"))
    rows = rows.withColumns({"base_trend": trend(), "part": F.try_divide(y, trend())})
    for level in LEVELS:
        of_class = F.sum("part").over(Window.partitionBy("sku", level)) / F.col(f"n_{level}")
        overall = F.sum("part").over(sku) / F.col("n_all")
        rows = rows.withColumn(f"{level}_idx", F.coalesce(F.try_divide(of_class, overall), F.lit(1.0)))
        rows = rows.withColumn("part", F.coalesce(F.try_divide("part", f"{level}_idx"), F.lit(0.0)))
    raw = F.greatest(F.lit(0.0), F.col("base_trend") * F.col("dow_idx") * F.col("month_idx") * F.col("hol_idx"))
    positive = y > 0
    per_sku = rows.groupBy("sku").agg(
        F.count("day").alias("n_rows"),
        *[F.first(c).alias(c) for c in ("slope", "intercept", "mean_y")],
        *[
            F.map_from_entries(F.collect_set(F.struct(F.col(level), F.col(f"{level}_idx")))).alias(f"{level}_index")
            for level in LEVELS
        ],
        F.avg(F.when(positive, y)).alias("avg_y"),
        F.avg(F.when(positive, raw)).alias("avg_p"),
    )
    factor = F.least(F.greatest(F.col("avg_y") / F.col("avg_p"), F.lit(0.2)), F.lit(5.0))
    fitted = {
        "slope": F.col("slope"),
        "intercept": F.col("intercept"),
        "mean_y": F.col("mean_y"),
        **{f"{level}_index": F.col(f"{level}_index") for level in LEVELS},
        "gap_index": F.when(F.col("mean_y") != 0, F.lit(0.0)).otherwise(F.lit(1.0)),
        "cal_factor": F.when(F.col("avg_p") > 0.01, factor).otherwise(F.lit(1.0)),
    }
    return per_sku.select(
        "sku",
        F.coalesce("avg_y", F.lit(0.0)).alias("simple_avg"),
        *[F.when(F.col("n_rows") >= min_days, c).alias(n) for n, c in fitted.items()],
    )


FIT_COLUMNS = ["slope", "intercept", "mean_y", "dow_index", "month_index", "hol_index", "gap_index", "cal_factor", "simple_avg"]


def trend(t: str = "t") -> Column:
    return F.greatest(F.col("intercept") + F.col("slope") * F.col(t), 0.1 * F.col("mean_y"))


def class_index(level: str, of: Column | None = None) -> Column:
    return F.coalesce(F.element_at(f"{level}_index", F.col(level) if of is None else of), "gap_index")


def components(rows: DataFrame) -> DataFrame:
    """Add base_yhat, base_trend, base_weekly, base_yearly.

    Needs the fit columns and t, dow, month, hol. SKUs without a fit get their
    average demand (0 if there is none) and no components.
    """
    fitted = F.col("slope").isNotNull()
    raw = F.greatest(F.lit(0.0), trend() * class_index("dow") * class_index("month") * class_index("hol"))

    def only_fitted(c: Column) -> Column:
        return F.when(fitted, c).otherwise(F.lit(0.0))

    return rows.withColumns(
        {
            "base_yhat": F.coalesce(F.when(fitted, raw * F.col("cal_factor")), "simple_avg", F.lit(0.0)),
            "base_trend": only_fitted(trend()),
            "base_weekly": only_fitted(class_index("dow") - 1),
            "base_yearly": only_fitted(class_index("month") - 1),
        }
    )


COMPONENTS = ["base_yhat", "base_trend", "base_weekly", "base_yearly"]


def simple_average(daily: DataFrame) -> DataFrame:
    """(sku, simple_avg): mean demand over demand days, else 0."""
    return daily.groupBy("sku").agg(
        F.coalesce(F.avg(F.when(F.col("demand") > 0, F.col("demand"))), F.lit(0.0)).alias("simple_avg")
    )


def predict(rows: DataFrame, dimension: DataFrame, days: DataFrame, start: Column) -> DataFrame:
    """Add the baseline columns to (sku, day) rows."""
    cal = class_calendar(days, start).select("day", "t", *LEVELS)
    joined = rows.join(F.broadcast(cal), "day", "left").join(dimension, "sku", "left")
    return components(joined).select(*rows.columns, *COMPONENTS)


def summary(predicted: DataFrame, dimension: DataFrame, segments: DataFrame, frequency: DataFrame) -> DataFrame:
    """Per fitted SKU: segment, mean prediction, trend slope, calibration, demand frequency.

    slope = (last trend - first trend) / number of days; ``predicted`` covers all fitted days.
    """
    per_sku = predicted.groupBy("sku").agg(
        F.avg("base_yhat").alias("mean_yhat"),
        ((F.max_by("base_trend", "day") - F.min_by("base_trend", "day")) / F.count("day")).alias("trend_slope"),
    )
    fitted = dimension.where(F.col("slope").isNotNull()).select("sku", "cal_factor")
    return (
        per_sku.join(fitted, "sku")
        .join(segments.select("sku", "segment"), "sku", "left")
        .join(frequency, "sku", "left")
        .select(
            "sku", F.coalesce("segment", F.lit("LF")).alias("segment"), "mean_yhat", "trend_slope", "cal_factor", "demand_freq"
        )
    )
