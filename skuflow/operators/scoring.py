"""Batch scoring without a served model: forecast dates, bands, explanations, preparation orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions.calendar import calendar_columns
from skuflow.functions.clean import even_rounded, pick_quantity
from skuflow.functions.holidays import HOLIDAY_FEATURES
from skuflow.operators.features import EPS, HF_INTERACTIONS

# Tuned blend of the published model.
ALPHA, BIAS_MULTIPLIER, PROB_POWER = 0.725, 0.9, 3.0
# What the serving approximation assumes about a SKU's recent past.
APPROX_STD, APPROX_MAX, APPROX_MIN, APPROX_CV, APPROX_DAY_IDX = 0.3, 1.5, 0.5, 0.5, 600.0
# Features that are 0 without a history.
NO_HISTORY = {
    "del_rolling_7", "del_rolling_14", "del_rolling_28", "del_qty_rolling_7", "del_qty_rolling_28", "base_weekly", "base_yearly",
    "base_weekly_abs", "base_yearly_abs", "base_seasonal_str", "base_resid_lag1", "base_resid_rmean7",
}
BAND_Z, BAND_SHARE, BAND_FALLBACK = 1.96, 0.4, 0.5


def forecast_rows(skus: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every SKU on every forecast date; the dates unfold inside each SKU's row."""
    return skus.withColumns({"_s": start, "_e": end}).withColumn("day", F.explode(F.sequence("_s", "_e"))).drop("_s", "_e")


def with_band(rows: DataFrame, pred: str = "pred", average: str = "avg_demand") -> DataFrame:
    """conf_low, conf_high: pred -/+ 1.96 sigma, floored at 0; sigma from the average demand."""
    sigma = F.when(F.col(average) > 0, BAND_SHARE * F.col(average)).otherwise(BAND_FALLBACK * F.col(pred))
    zero = F.lit(0.0)
    return rows.withColumns(
        {
            "conf_low": F.greatest(zero, F.col(pred) - BAND_Z * sigma),
            "conf_high": F.greatest(zero, F.col(pred) + BAND_Z * sigma),
        }
    )


def _norm(value: Column, average: Column) -> Column:
    return value / F.greatest(average, F.lit(EPS))


def approximate_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """Feature columns for serving without a demand history (option; real lags are the default).

    Lags, means and weighted means are the SKU's baseline ``mean_yhat``, spreads
    are fixed shares of it. ``rows`` has day, the SKU's static columns (mean_yhat,
    avg_demand, demand_freq, demand_days, is_hf ...) and the holiday columns.
    What only a recent history could tell (NO_HISTORY) is 0. A name that is neither known here nor a column of ``rows``
    is an error.
    """
    level, average = F.coalesce("mean_yhat", F.lit(0.0)), F.coalesce("avg_demand", F.lit(0.0))
    freq = F.coalesce("demand_freq", F.lit(0.0))
    known: dict[str, Column] = dict(calendar_columns("day"))
    known |= {h: F.coalesce(F.col(h), F.lit(0.0)) for h in HOLIDAY_FEATURES if h in rows.columns}  # null outside the known years
    known |= {
        "day_idx": F.lit(APPROX_DAY_IDX),
        "day_idx_sq": F.lit(APPROX_DAY_IDX**2 / 1e6),
        "base_yhat": level,
        "base_trend": level,
        "base_ratio": _norm(level, average),
        "base_trend_norm": level / (F.greatest(average, F.lit(EPS)) + EPS),
        "base_over_ewm7": level / (level + EPS),
        "base_over_rmean7": level / (level + EPS),
        "prod_avg_demand": average,
        "prod_med_demand": average,
        "prod_std_demand": average * 0.5,
        "prod_n_days": F.col("demand_days").cast("double"),
        "days_since": 1.0 / F.greatest(freq, F.lit(0.01)),
        "cv_28": F.lit(APPROX_CV),
        "rmean7_over_28": F.lit(1.0),
    }

    def column(name: str) -> Column:
        if name in known:
            return known[name]
        if name in HF_INTERACTIONS:
            return F.coalesce("is_hf", F.lit(0.0)) * column(HF_INTERACTIONS[name])
        stem, _, tail = name.rpartition("_")
        if stem == "rsum":
            return level * int(tail)
        by_stem = {
            "lag": level, "rmean": level, "rmed": level, "ewm": level, "rstd": level * APPROX_STD,
            "rmax": level * APPROX_MAX, "rmin": F.greatest(level * APPROX_MIN, F.lit(0.0)), "dfreq": freq,
        }
        if tail == "norm":
            return _norm(level, average)
        if stem in by_stem:
            return by_stem[stem]
        if name in rows.columns:
            return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        if name in NO_HISTORY:
            return F.lit(0.0)
        raise ValueError(f"no approximation for feature {name}")

    return rows.select("sku", "day", *[column(n).alias(n) for n in names])


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """One row about a forecast run. ``forecast``: sku, day, pred; one row per pair."""
    return forecast.groupBy("sku").agg(
        F.count("day").alias("rows"), F.count_if(F.col("pred") > 0).alias("positive"), F.sum("pred").alias("qty"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    ).agg(
        F.count("sku").alias("n_products"),
        (F.datediff(F.max("last_day"), F.min("first_day")) + 1).cast("bigint").alias("n_days"),
        F.sum("rows").alias("n_rows"),
        F.sum("positive").alias("n_positive"),
        even_rounded(F.sum("qty")).alias("total_quantity"),
    )


def sample_rows(forecast: DataFrame, k: int = 5) -> DataFrame:
    """First and last k rows in (day, sku) order: two top-k plans, no full sort."""
    head = forecast.orderBy("day", "sku").limit(k)
    tail = forecast.orderBy(F.desc("day"), F.desc("sku")).limit(k)
    return head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail")))


def preparation_order(forecast: DataFrame, overrides: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines to prepare: forecast or override, source slot, status.

    ``forecast``: sku, pred; ``overrides``: sku, override_qty; ``stock``: sku,
    slot_id, code (the slot the next outgoing event takes). Where forecast and
    overrides have a day, the order is one per day.
    """
    dated = ["day"] if "day" in forecast.columns else []
    rows = forecast.join(overrides, ["sku", *dated], "left").join(stock, "sku", "left")
    qty = F.coalesce("override_qty", "pred")
    return rows.where(qty > 0).select(
        "sku",
        *dated,
        even_rounded("pred").alias("predicted_demand"),
        F.col("override_qty").isNotNull().alias("override_applied"),
        F.coalesce("code", F.lit("Non stocke")).alias("source_location"),
        F.coalesce("slot_id", F.lit(0).cast("bigint")).alias("source_location_id"),
        even_rounded(qty).alias("quantity_to_prepare"),
        F.when(F.col("slot_id").isNotNull(), "ready").otherwise("missing_stock").alias("status"),
        F.when(F.col("slot_id").isNotNull(), pick_quantity(qty)).alias("pick_quantity"),
    )


def _text(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(c, F.lit(0.0)) + 1e-9)


def explain(rows: DataFrame) -> DataFrame:
    """One record per forecast: values, band, decision and the eight factors behind it.

    Needs sku, day, pred, probability, conf_low, conf_high, segment, mean_yhat,
    avg_demand, demand_freq, trend_slope, cal_factor.
    """
    listed = [
        ("Baseline (mean_yhat)", _text("mean_yhat", 2), F.lit("high"), "Per-SKU baseline level"),
        ("Classifier probability", _text("probability", 4),
         F.when(F.col("probability") > 0.5, "high").otherwise("medium"), "Probability of demand on the day"),
        ("Demand frequency", _text("demand_freq", 4), F.lit("high"), "Share of days with demand"),
        ("Segment", F.col("segment"), F.lit("medium"), "HF = high frequency, LF = low frequency"),
        ("Avg historical demand", _text("avg_demand", 2), F.lit("medium"), "Mean demand on demand days"),
        ("Calendar (day_of_week)", F.weekday("day").cast("string"), F.lit("low"), "Day of the week, 0 = Monday"),
        ("Trend slope", _text("trend_slope", 4), F.lit("low"), "Slope of the baseline trend"),
        ("Calibration factor", _text("cal_factor", 3), F.lit("medium"), "Actual over predicted level"),
    ]
    factors = F.array(
        *[
            F.struct(F.lit(n).alias("factor"), v.alias("value"), i.alias("impact"), F.lit(d).alias("description"))
            for n, v, i, d in listed
        ]
    )
    record = F.struct(
        F.col("mean_yhat").alias("baseline"),
        F.col("probability"),
        F.when(F.col("pred") > 0, "demand predicted").otherwise("no demand").alias("decision"),
        F.lit(ALPHA).alias("alpha"),
        F.lit(BIAS_MULTIPLIER).alias("bias_multiplier"),
    )
    return rows.select(
        "sku", "day", "segment", "pred", "conf_low", "conf_high", record.alias("explanation"), factors.alias("top_factors")
    )
