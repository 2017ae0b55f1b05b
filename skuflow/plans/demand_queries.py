"""Registered queries on demand: statistics, grid, features, calendar, baseline, evaluation.

Dense features are those of the grid with all days of all SKUs. They are
returned for the demand rows, the rows the quantity model learns from, so they
are computed there, by frames of days (``operators/sparse_features.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.functions import holidays as H
from skuflow.functions.calendar import calendar_columns
from skuflow.functions.clean import rounded
from skuflow.operators import baseline as B
from skuflow.operators import demand as D
from skuflow.operators import evaluate as E
from skuflow.operators import features as X
from skuflow.operators import grid as G
from skuflow.operators import regression as R
from skuflow.operators import sparse_features as Y
from skuflow.session import materialize
from skuflow.sources import tables as S


@dataclass
class Demand:
    history: DataFrame
    start: Column
    end: Column
    daily: DataFrame

    def grid(self, carry: DataFrame | None = None) -> DataFrame:
        """Dense grid; ``carry`` is a per-SKU dimension repeated on every row."""
        sparse, names = self._carrying(carry)
        return G.demand_grid(D.spread_by_sku(sparse), self.start, self.end, carry=names)

    def facts(self, carry: DataFrame | None = None) -> DataFrame:
        """The cells of the grid that hold facts, for ``sparse_features``."""
        sparse, names = self._carrying(carry)
        return G.demand_grid(sparse, self.start, self.end, carry=names, empty_days=False)

    def _carrying(self, carry: DataFrame | None) -> tuple[DataFrame, list[str]]:
        if carry is None:
            return self.daily, []
        return self.daily.join(carry, "sku", "left"), [c for c in carry.columns if c != "sku"]

    def shared(self) -> Demand:
        """Write the daily totals once for plans that read them in several branches; the bounds come from them too."""
        daily = materialize(self.daily, "daily")
        return Demand(self.history, *G.day_bounds(daily), daily)

    def days(self) -> DataFrame:
        return G.calendar(self.start, self.end, self.history.sparkSession)


def by_part(spark: SparkSession, sf: str) -> Demand:
    return _demand(S.demand_history(spark, sf))


def by_line(spark: SparkSession, sf: str) -> Demand:
    return _demand(S.line_history(spark, sf))


def _demand(history: DataFrame) -> Demand:
    start, end = G.day_bounds(history)
    return Demand(history, start, end, D.capped_daily(D.daily_demand(history)))


def demand_rows(grid: DataFrame, cols: list[str]) -> DataFrame:
    return grid.where("has_demand = 1").select("sku", "day", *[rounded(c).alias(c) for c in cols])


def daily_demand_capped(spark, sf):
    return by_part(spark, sf).daily.select("sku", "day", rounded("demand").alias("demand"))


def _deliveries(spark, sf):
    return D.deliveries(S.transactions(spark, sf), S.transaction_lines(spark, sf))


def delivery_stats(spark, sf):
    return D.delivery_stats(_deliveries(spark, sf)).select(
        "sku", "del_total_count", "del_total_qty", "del_n_days", rounded("del_avg_qty").alias("del_avg_qty")
    )


def demand_grid(spark, sf):
    """Every cell of the grid, summed up per day."""
    return by_part(spark, sf).grid().groupBy("day").agg(
        F.count("sku").alias("cells"), F.sum("has_demand").alias("filled"), rounded(F.sum("demand")).alias("demand")
    )


def demand_frequency(spark, sf):
    d = by_part(spark, sf)
    daily = d.daily.withColumn("_n", D.n_days(d.start, d.end))
    return D.demand_frequency(daily, F.max("_n")).select("sku", rounded("demand_freq", 6).alias("demand_freq"))


def sparsity_profile(spark, sf):
    return D.sparsity_profile(by_part(spark, sf).daily).withColumn("sparsity", rounded("sparsity", 6))


def sku_stats(spark, sf):
    cols = ["prod_avg_demand", "prod_med_demand", "prod_std_demand"]
    return D.sku_stats(by_part(spark, sf).daily).select("sku", *[rounded(c).alias(c) for c in cols], "prod_n_days")


def sku_totals_topk(spark, sf):
    """The 15 SKUs with the highest demand."""
    totals = D.sku_totals(by_part(spark, sf).daily).withColumn("total_demand", rounded("total_demand"))
    return totals.orderBy(F.desc("total_demand"), "sku").limit(15)


def baseline_candidates(spark, sf):
    """SKUs with and without enough demand days for a fitted baseline."""
    totals = D.sku_totals(by_part(spark, sf).daily)
    fitted = D.fit_candidates(totals, 25)
    rest = D.without_fit(totals, fitted)
    return fitted.withColumn("kind", F.lit("fitted")).unionByName(rest.withColumn("kind", F.lit("average")))


def demand_summary(spark, sf):
    cols = ["mean", "std", "min", "q1", "median", "q3", "max"]
    return D.numeric_summary(by_part(spark, sf).shared().daily, "demand").select("n", *[rounded(c).alias(c) for c in cols])


def segment_counts(spark, sf):
    return D.value_counts(D.segments(by_part(spark, sf).daily), "segment")


def sku_segments(spark, sf):
    return D.segments(by_part(spark, sf).daily)


def _features(cols: list[str], *groups):
    def query(spark, sf):
        return demand_rows(X.add(by_part(spark, sf).facts(), *groups), cols)

    return query


lag_features = _features(
    [f"lag_{n}" for n in X.LAGS] + ["lag_w1", "lag_w2", "lag_w4", "rmean_wday4"], Y.LAG, Y.SAME_WEEKDAY
)
rolling_features = _features([f"{p}_{w}" for w in X.MEAN_WINDOWS for p in ("rmean", "rstd")], Y.MOMENTS)
rolling_extremes = _features(
    [f"{p}_{w}" for w in X.EXTREME_WINDOWS for p in ("rmax", "rmin", "rsum")], Y.EXTREMES, Y.SUMS
)
rolling_median = _features([f"rmed_{w}" for w in X.EXTREME_WINDOWS], Y.MEDIANS)
freq_features = _features([f"dfreq_{w}" for w in X.FREQ_WINDOWS], Y.FREQUENCY)
days_since = _features(["days_since", "days_since_last"], Y.DAYS_SINCE)
ewm_features = _features(["ewm_7", "ewm_28"], Y.EWM)


def ratio_features(spark, sf):
    d = by_part(spark, sf).shared()
    grid = X.add(d.facts(carry=D.sku_stats(d.daily)), Y.LAG, Y.SAME_WEEKDAY, Y.MOMENTS, Y.EWM, Y.RATIOS)
    cols = ["cv_28", "lag1_norm", "rmean7_norm", "rmean28_norm", "ewm7_norm", "ewm28_norm", "rmean_wday4_norm"]
    return demand_rows(grid, cols)


def delivery_rolling(spark, sf):
    d = by_part(spark, sf)
    facts = G.merge_facts(d.daily, _shifted_deliveries(spark, sf), d.start, d.end)
    grid = G.demand_grid(facts, d.start, d.end, ("demand", "n_deliveries", "qty_delivered"), empty_days=False)
    cols = ["n_deliveries", "qty_delivered"] + [f"del_rolling_{w}" for w in (7, 14, 28)]
    return demand_rows(X.add(grid, Y.DELIVERY_ROLLING), cols + [f"del_qty_rolling_{w}" for w in (7, 28)])


def _shifted_deliveries(spark, sf):
    headers = S.transactions(spark, sf).withColumn("created_at", S.shifted_day("created_at"))
    return D.deliveries(headers, S.transaction_lines(spark, sf))


def calendar_features(spark, sf):
    """Calendar columns of every day with demand, with the demand of the day."""
    d = by_part(spark, sf)
    per_day = d.history.groupBy("day").agg(F.sum("qty").alias("qty")).withColumn("_start", d.start)
    cols = calendar_columns("day", F.col("_start"))
    return per_day.select("day", "qty", *[rounded(c, 6).alias(n) for n, c in cols.items()])


def holiday_features(spark, sf):
    """Holiday columns of every day with demand, with the demand of the day."""
    d = by_part(spark, sf)
    per_day = d.history.groupBy("day").agg(F.sum("qty").alias("qty"))
    return H.with_holidays(per_day, d.days()).select("day", "qty", *[rounded(f, 6).alias(f) for f in H.HOLIDAY_FEATURES])


def holiday_events(spark, sf):
    """Event days of the holiday calendar with the demand sold on them."""
    history = S.demand_history(spark, sf)
    per_day = history.groupBy("day").agg(F.sum("qty").alias("qty"), F.count("sku").alias("n_lines"))
    return (
        H.holiday_events(spark)
        .join(per_day, F.col("ds") == F.col("day"), "left")
        .select("holiday", "ds", "lower_window", "upper_window", F.coalesce("qty", F.lit(0.0)).alias("qty"),
                F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    )


def category_codes(spark, sf):
    products = S.products(spark, sf)
    codes = X.category_codes(products)
    return products.join(codes, "category", "left").groupBy("category", "cat_enc").agg(F.count("sku").alias("n_skus"))


def hf_interactions(spark, sf):
    d = by_part(spark, sf).shared()
    seg = D.segments(d.daily).select("sku", (F.col("segment") == "HF").cast("double").alias("is_hf"))
    grid = X.add(d.facts(carry=seg), Y.LAG, Y.MOMENTS, Y.FREQUENCY, Y.DAYS_SINCE)
    grid = H.with_holidays(grid, d.days()).withColumns(
        {k: v for k, v in calendar_columns("day").items() if k in ("dow", "month", "is_wknd")}
    )
    cols = [c for c in X.HF_INTERACTIONS if c != "hf_x_base"]
    return demand_rows(X.hf_interactions(grid), cols)


# ------------------------------------------------------------------ baseline


def _fitted(d: Demand) -> DataFrame:
    return B.fitted_dimension(d.daily, d.days(), d.start)


def baseline_parameters(spark, sf):
    """Trend line and class indices per product line, one row per (line, class)."""
    d = by_line(spark, sf)
    fit = B.fitted_dimension(d.daily, d.days(), d.start, min_days=0)
    classes = [
        F.struct(F.lit(level).alias("level"), F.lit(k).alias("class"), B.class_index(level, F.lit(k)).alias("idx"))
        for level, ks in B.LEVELS.items()
        for k in ks
    ]
    return fit.select(
        "sku", rounded("slope", 6).alias("slope"), rounded("intercept").alias("intercept"), F.inline(F.array(*classes))
    ).withColumn("idx", rounded("idx"))


def baseline_components(spark, sf):
    """Prediction and components, computed for every product line and day, returned for the demand rows."""
    d = by_line(spark, sf).shared()
    out = B.predict(d.grid(), _fitted(d), d.days(), d.start).where("has_demand = 1")
    return out.select("sku", "day", *[rounded(c, 3).alias(c) for c in B.COMPONENTS])


def baseline_regression(spark, sf):
    """Coefficients of every part's regression baseline, and its mean prediction and error on demand days."""
    d = by_part(spark, sf).shared()
    days = d.days()
    fitted = R.fit(d.daily, days, d.start)
    fitted = replace(fitted, coefficients=materialize(fitted.coefficients, "regression"))
    calendar, _ = R.calendar_design(days, d.start, days.count())
    error = R.predict(fitted, d.daily, calendar).groupBy("sku").agg(
        rounded(F.avg("yhat"), 4).alias("mean_yhat"), rounded(F.sum(F.abs(F.col("demand") - F.col("yhat"))) / F.sum("demand") * 100, 2).alias("wape")
    )
    named = [rounded(F.col("beta")[i], 6).alias(n) for i, n in enumerate(fitted.design.names)]
    return fitted.coefficients.select("sku", *named).join(error, "sku")


def baseline_calibrated(spark, sf):
    """Per product line: segment, mean prediction, slope, calibration factor, frequency."""
    d = by_line(spark, sf).shared()
    fitted = _fitted(d)
    predicted = B.predict(d.grid().select("sku", "day"), fitted, d.days(), d.start)
    freq = D.demand_frequency(d.daily.withColumn("_n", D.n_days(d.start, d.end)), F.max("_n"))
    out = B.summary(predicted, fitted, D.segments(d.daily), freq)
    return out.select(
        "sku", "segment", *[rounded(c).alias(c) for c in ("mean_yhat", "cal_factor", "demand_freq")],
        rounded("trend_slope", 6).alias("trend_slope"),
    )


def baseline_features(spark, sf):
    """Residual and ratio features of the baseline on demand rows."""
    d = by_line(spark, sf).shared()
    grid = B.predict(d.grid(carry=D.sku_stats(d.daily)), _fitted(d), d.days(), d.start)
    grid = X.add(grid, X.EWM, X.MOMENTS, X.BASELINE)
    cols = ["base_ratio", "base_resid_lag1", "base_resid_rmean7", "base_trend_norm", "base_weekly_abs",
            "base_yearly_abs", "base_seasonal_str"]
    return grid.where("has_demand = 1").select("sku", "day", *[rounded(c, 3).alias(c) for c in cols])


# ---------------------------------------------------------------- evaluation

TEST_DAYS = 30


def _evaluation(spark, sf) -> DataFrame:
    """Last 30 days of every product line: actual, lag-1, EWM-7 and baseline predictions, segment."""
    d = by_line(spark, sf).shared()
    segment = D.segments(d.daily).select("sku", "segment")
    grid = G.recent_grid(d.daily.join(segment, "sku"), d.start, d.end, TEST_DAYS + 1, {"ewm_7": X.EWM_DECAY[7]}, ["segment"])
    _, test = G.train_test(grid, d.end, TEST_DAYS)
    return B.predict(
        test.select("sku", "day", "segment", F.col("demand").alias("actual"), "lag_1", "ewm_7"), _fitted(d), d.days(), d.start
    ).withColumn("first_day", F.date_sub(d.end, TEST_DAYS - 1))


PARTS = {"lag_1": "lag_1", "ewm_7": "ewm_7", "baseline": "base_yhat"}
BLENDS = (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0)
MODELS = {n: {n: 1.0} for n in PARTS} | {f"blend_{a}": {"baseline": a, "ewm_7": 1 - a} for a in BLENDS}


def wape_models(spark, sf):
    preds = {m: sum((F.col(PARTS[n]) * w for n, w in mixed.items()), F.lit(0.0)) for m, mixed in MODELS.items()}
    scored = E.scores(_evaluation(spark, sf), preds)
    cols = ["wape_dd", "bias_dd", "wape_grid", "bias_grid"]
    return scored.select("model", *[rounded(c, 3).alias(c) for c in cols], "n_demand", "n_rows")


def wape_10d(spark, sf):
    tagged = E.windowed(_evaluation(spark, sf), F.col("first_day"), TEST_DAYS)
    scored = E.window_model_scores(tagged, {n: F.col(c) for n, c in PARTS.items()}, MODELS)
    return scored.select("model", rounded("wape_10d", 3).alias("wape_10d"), rounded("bias_10d", 3).alias("bias_10d"))


def wape_segment(spark, sf):
    rows = _evaluation(spark, sf).withColumn("pred", F.col("base_yhat"))
    daily = E.segment_scores(rows)
    horizon = E.window_scores(E.windowed(rows, F.col("first_day"), TEST_DAYS), ["segment"])
    return daily.join(horizon.select("segment", "wape_10d"), "segment", "left").select(
        "segment", *[rounded(c, 3).alias(c) for c in ("wape_dd", "bias_dd", "wape_10d")], "n_demand"
    )


def lag1_accuracy(spark, sf):
    """WAPE and bias of yesterday's demand as the forecast, on demand rows, over the whole history.

    Yesterday is the row before if that is one day back, else a day without demand: no grid is needed.
    """
    before = Window.partitionBy("sku").orderBy("day")
    daily = by_part(spark, sf).daily.select(
        F.col("demand").alias("actual"),
        F.when(F.lag("day").over(before) == F.date_sub("day", 1), F.lag("demand").over(before)).otherwise(F.lit(0.0)).alias("pred"),
    )
    return daily.where("actual > 0").agg(
        rounded(E.wape(), 3).alias("wape"), rounded(E.bias(), 3).alias("bias"), F.count(F.lit(1)).alias("n_rows")
    )


def _pseudo_scored(spark, sf) -> DataFrame:
    """Grid rows with a deterministic stand-in for the classifier's probability."""
    grid = by_part(spark, sf).grid()
    p = ((F.col("sku") * 31 + F.col("day_no") * 17) % 1000) / 1000.0
    return grid.select("sku", "day", F.col("has_demand").alias("label"), p.alias("score"))


def auc_exact(spark, sf):
    return E.auc(_pseudo_scored(spark, sf)).withColumn("auc", rounded("auc", 6))


def confusion(spark, sf):
    out = E.confusion(_pseudo_scored(spark, sf), 0.4)
    return out.withColumns({c: rounded(c, 6) for c in ("precision", "recall")})


QUERIES = {
    f.__name__: f
    for f in (
        daily_demand_capped, delivery_stats, demand_grid, demand_frequency, sparsity_profile, sku_stats,
        sku_totals_topk, baseline_candidates, demand_summary, segment_counts, sku_segments, ratio_features,
        delivery_rolling, calendar_features, holiday_features, holiday_events, category_codes, hf_interactions,
        baseline_parameters, baseline_components, baseline_regression, baseline_calibrated, baseline_features, wape_models, wape_10d,
        wape_segment, lag1_accuracy, auc_exact, confusion,
    )
} | {
    "lag_features": lag_features,
    "rolling_features": rolling_features,
    "rolling_extremes": rolling_extremes,
    "rolling_median": rolling_median,
    "freq_features": freq_features,
    "days_since": days_since,
    "ewm_features": ewm_features,
}
