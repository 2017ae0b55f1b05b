"""Registered queries on tuning, models, scoring, preparation orders, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions import labels as L
from skuflow.functions.clean import even_rounded, rounded
from skuflow.functions.holidays import with_holidays
from skuflow.operators import baseline as B
from skuflow.operators import demand as D
from skuflow.operators import evaluate as E
from skuflow.operators import features as X
from skuflow.operators import grid as G
from skuflow.operators import ledger as K
from skuflow.operators import models as M
from skuflow.operators import picking as P
from skuflow.operators import scoring as C
from skuflow.operators import tuning as T
from skuflow.plans import training
from skuflow.plans.demand_queries import TEST_DAYS, Demand, by_line, by_part
from skuflow.plans.warehouse_queries import _stock_plan
from skuflow.session import materialize, new_shared_path
from skuflow.sources import files
from skuflow.sources import tables as S
from skuflow.streaming import keyed_ledger
from skuflow.streaming import ledger as live_ledger
from skuflow.streaming import movements

HORIZON_DAYS = 31
ORDER_DAYS = 7

# ---------------------------------------------------------------------- tuning


def _tuning_rows(spark, sf) -> DataFrame:
    """Last 30 days per part: two level predictions and a deterministic stand-in for the probability."""
    d = by_part(spark, sf).shared()
    daily = d.daily.join(B.simple_average(d.daily), "sku")
    grid = G.recent_grid(daily, d.start, d.end, TEST_DAYS + 28, {"ewm_7": X.EWM_DECAY[7]}, ["simple_avg"])
    grid = grid.withColumn("rmean_28", F.avg("demand").over(Window.partitionBy("sku").orderBy("day").rowsBetween(-28, -1)))
    _, test = G.train_test(grid, d.end, TEST_DAYS)
    rows = test.withColumn("_first", F.date_sub(d.end, TEST_DAYS - 1))
    tagged = E.windowed(rows, F.col("_first"), TEST_DAYS)
    return materialize(
        tagged.select(
            "win",
            "sku",
            F.col("demand").alias("actual"),
            F.col("simple_avg").alias("base"),
            F.col("rmean_28").alias("reg"),
            F.col("ewm_7").alias("ewm"),
            (((F.col("sku") * 31 + F.col("day_no") * 17) % 1000) / 1000.0).alias("p"),
        ),
        "tuning",
    )


def _rounded_metrics(best: DataFrame) -> DataFrame:
    return best.withColumns({c: rounded(c) for c in ("wape", "bias", "score") if c in best.columns})


def tune_threshold(spark, sf):
    return _rounded_metrics(T.tune_threshold(_tuning_rows(spark, sf)))


def tune_expected_value(spark, sf):
    return _rounded_metrics(T.tune_expected_value(_tuning_rows(spark, sf)))


def tune_daily(spark, sf):
    return _rounded_metrics(T.tune_daily(_tuning_rows(spark, sf)))


def tuned_mode(spark, sf):
    rows = _tuning_rows(spark, sf)
    return _rounded_metrics(T.choose_mode(T.tune_threshold(rows), T.tune_expected_value(rows)))


# --------------------------------------------------------------------- scoring


def _frequency(d: Demand) -> DataFrame:
    return D.demand_frequency(d.daily.withColumn("_n", D.n_days(d.start, d.end)), F.max("_n"))


def _future(d: Demand, days: int = HORIZON_DAYS) -> tuple[DataFrame, DataFrame]:
    """(forecast rows with baseline and frequency, future calendar)."""
    first, last = F.date_add(d.end, 1), F.date_add(d.end, days)
    calendar = G.calendar(first, last, d.history.sparkSession)
    fitted = B.fitted_dimension(d.daily, d.days(), d.start)
    skus = fitted.select("sku", F.col("simple_avg").alias("reg_qty")).join(_frequency(d), "sku")
    rows = C.forecast_rows(skus, first, last)
    return B.predict(rows, fitted, calendar, d.start), calendar


def _scored(d: Demand, days: int = HORIZON_DAYS) -> DataFrame:
    """Expected-value forecast with the SKU's demand frequency as probability."""
    rows, _ = _future(d, days)
    rows = rows.withColumn("probability", F.col("demand_freq"))
    rows = rows.withColumn("pred", M.expected_value(C.ALPHA, C.BIAS_MULTIPLIER, 1.0))
    return C.with_band(rows.withColumn("avg_demand", F.col("reg_qty")))


def batch_forecast(spark, sf):
    cols = ["pred", "conf_low", "conf_high"]
    return _scored(by_line(spark, sf).shared()).select(
        "sku", "day", *[rounded(c, 2).alias(c) for c in cols], rounded("probability").alias("probability")
    )


def forecast_summary(spark, sf):
    scored = _scored(by_line(spark, sf).shared()).withColumn("pred", rounded("pred", 2))
    return C.forecast_summary(scored)


def forecast_sample(spark, sf):
    scored = _scored(by_line(spark, sf).shared())
    return C.sample_rows(scored.select("sku", "day", rounded("pred", 2).alias("pred")))


def forecast_file(spark, sf):
    """The forecast written as CSV files (day-first dates, one folder per day) and read back."""
    path = new_shared_path(spark, "forecast")
    files.write_forecast(_scored(by_line(spark, sf).shared()), path, style="day_first", by_day=True)
    back = files.dimension_csv(spark, path, "`Date` string, id_produit string, quantite_demande double, day date")
    return back.groupBy("Date").agg(
        F.count("id_produit").alias("n_products"), rounded(F.sum("quantite_demande"), 1).alias("quantity")
    )


def _profile(d: Demand) -> DataFrame:
    """Static columns per SKU for explanations and approximate serving."""
    fitted = B.fitted_dimension(d.daily, d.days(), d.start)
    predicted = B.predict(d.grid().select("sku", "day"), fitted, d.days(), d.start)
    static = B.summary(predicted, fitted, D.segments(d.daily), _frequency(d))
    totals = D.sku_totals(d.daily).select("sku", F.col("n_demand_days").alias("demand_days"))
    return static.join(B.simple_average(d.daily).withColumnRenamed("simple_avg", "avg_demand"), "sku").join(totals, "sku")


def forecast_explained(spark, sf):
    """Explanation of every product line's forecast for the first day after the history."""
    d = by_line(spark, sf).shared()
    rows = _scored(d, days=1).drop("avg_demand", "demand_freq").join(_profile(d), "sku")
    out = C.explain(rows)
    factor = lambda f: F.concat_ws("|", f["factor"], f["value"], f["impact"])
    return out.select(
        "sku", "day", "segment", *[rounded(c, 2).alias(c) for c in ("pred", "conf_low", "conf_high")],
        F.col("explanation.decision").alias("decision"),
        F.array_join(F.transform("top_factors", factor), "; ").alias("factors"),
    )


APPROXIMATED = [
    "lag_1", "lag_28", "rmean_7", "rmean_wday4", "rstd_14", "rmax_28", "rmin_7", "rmed_14", "rsum_28", "dfreq_60", "days_since",
    "cv_28", "ewm_7", "ewm28_norm", "lag1_norm", "rmean7_over_28", "base_yhat", "base_ratio", "base_over_ewm7",
    "prod_std_demand", "prod_n_days", "day_idx", "day_idx_sq", "dow", "week", "is_month_end", "del_rolling_7",
    "base_weekly", "hf_x_dow", "hf_x_lag1", "hf_x_dfreq7", "hf_x_days_since", "fourier_sin_y1",
]


def approximate_features(spark, sf):
    """Serving features without history for the first 31 days after it."""
    d = by_line(spark, sf).shared()
    first, last = F.date_add(d.end, 1), F.date_add(d.end, HORIZON_DAYS)
    skus = _profile(d).withColumn("is_hf", (F.col("segment") == "HF").cast("double"))
    rows = with_holidays(C.forecast_rows(skus, first, last), G.calendar(first, last, spark))
    out = C.approximate_features(rows, APPROXIMATED)
    return out.select("sku", "day", *[rounded(c, 3).alias(c) for c in APPROXIMATED])


def _part_forecast(d: Demand) -> DataFrame:
    """Gated forecast per part: frequency against the threshold, blend of mean and median."""
    level = B.simple_average(d.daily).withColumnRenamed("simple_avg", "base_yhat")
    median = D.sku_stats(d.daily).select("sku", F.col("prod_med_demand").alias("reg_qty"))
    rows = level.join(median, "sku").join(_frequency(d), "sku")
    return rows.select("sku", M.gated(0.0115, C.ALPHA, C.BIAS_MULTIPLIER, p="demand_freq").alias("pred"))


def _preparation(spark, sf) -> DataFrame:
    d = by_part(spark, sf).shared()
    events = S.flow_events(spark, sf)
    asked = events.where(L.direction("flow_word") == "out")
    overrides = asked.groupBy("sku").agg(rounded(F.sum("qty"), 2).alias("override_qty"))
    return C.preparation_order(_part_forecast(d), overrides, _first_slots(spark, sf))


def _first_slots(spark, sf) -> DataFrame:
    """(sku, slot_id, code): where the oldest unit on hand lies."""
    plan = materialize(_stock_plan(spark, sf).where("slot_id IS NOT NULL"), "plan")
    first = plan.groupBy("sku").agg(F.min_by(F.struct("slot_id", "code"), F.struct("ts", "event_id")).alias("s"))
    return first.select("sku", "s.slot_id", "s.code")


def preparation_order(spark, sf):
    return _preparation(spark, sf)


def dated_preparation_order(spark, sf):
    """The order of every day of the week after the history, by that day's baseline and the tuned threshold mode.

    What went out on the last seven days of the event log replaces the forecast on the seven days of the order.
    """
    d = by_part(spark, sf).shared()
    best = T.tune_threshold(_tuning_rows(spark, sf)).first()
    rows, _ = _future(d, ORDER_DAYS)
    pred = M.gated(best["thr"] / 1000.0, best["alpha"] / 1000.0, best["mult"] / 100.0, p="demand_freq")
    asked = S.flow_events(spark, sf).where(L.direction("flow_word") == "out")
    back = F.datediff(S.flow_events(spark, sf).agg(F.max("day")).scalar(), "day")
    ahead = asked.where(back < ORDER_DAYS).withColumn("day", F.date_add(d.end, F.lit(ORDER_DAYS) - back))
    overrides = ahead.groupBy("sku", "day").agg(rounded(F.sum("qty"), 2).alias("override_qty"))
    return C.preparation_order(rows.select("sku", "day", pred.alias("pred")), overrides, _first_slots(spark, sf))


def preparation_tour(spark, sf):
    """Pick tour of the preparation order's ready lines."""
    ready = _preparation(spark, sf).where("status = 'ready'")
    items = ready.select(
        F.lit(1).cast("bigint").alias("order_id"),
        "sku",
        F.col("source_location_id").alias("slot_id"),
        F.col("pick_quantity").cast("double").alias("qty"),
    ).join(S.products(spark, sf).select("sku", "weight_kg"), "sku", "left")
    located, _ = P.locate(P.split_chariots(items, ("sku",)), S.slots(spark, sf, "customer"))
    return P.pick_tours(materialize(located, "located")).select("order_id", "chariot", "step", "action", "sku", "code", "distance")


# ---------------------------------------------------------------------- models


def _line_deliveries(spark, sf) -> DataFrame:
    headers = S.transactions(spark, sf).withColumn("created_at", S.shifted_day("created_at"))
    return D.deliveries(headers, S.line_transaction_lines(spark, sf))


#: Fewer and smaller trees than the defaults, and a bound on the labelled rows each model learns from.
MODEL = {"rounds": 20, "classifier_depth": 5, "regressor_depth": 5, "max_rows": 12_000}


def _trained(spark, sf) -> training.Trained:
    deliveries = _line_deliveries(spark, sf)
    return training.train(S.line_history(spark, sf), deliveries, products=S.line_products(spark, sf), **MODEL)


def product_features(spark, sf):
    """Category code, attributes and priorities per product line."""
    d = by_line(spark, sf).shared()
    static = training.priorities(d.daily, d.days()).join(training.product_features(S.line_products(spark, sf)), "sku", "left")
    return static.select("sku", *[rounded(c, 4).alias(c) for c in ("cat_enc", *training.PHYSICAL, *training.PRIORITY)])


def train_and_score(spark, sf):
    """Forecast of the last 30 days by models trained and tuned on the time before."""
    scored = _trained(spark, sf).scored_test
    return scored.select("sku", "day", "demand", "segment", "base_yhat", "probability", "reg_qty", even_rounded("pred").alias("pred"))


def model_forecast(spark, sf):
    """The 31 days after the history, scored by models that were trained, tuned, saved and loaded again.

    Each model learns from at most 12,000 rows, with up to 20 trees of depth 5 and early stop.
    """
    deliveries, products = _line_deliveries(spark, sf), S.line_products(spark, sf)
    trained = training.train(S.line_history(spark, sf), deliveries, products=products, **MODEL)
    d = by_line(spark, sf).shared()
    static = training.sku_dimension(d.daily, deliveries, d.days(), d.start, products)
    profile = _profile(d).drop("segment", "cal_factor", "trend_slope")
    path = new_shared_path(spark, "models")
    M.save(path, trained.classifier, trained.regressor, static.drop(*B.FIT_COLUMNS).join(profile, "sku"), trained.params)
    out = training.forecast(spark, path, trained.features, F.date_add(d.end, 1), F.date_add(d.end, HORIZON_DAYS))
    return out.select("sku", "day", "base_yhat", "probability", "reg_qty", rounded("pred").alias("pred"))


def feature_importance(spark, sf):
    """Top features of a quantity model learnt from at most 12,000 demand rows."""
    grid, features = training.feature_grid(S.line_history(spark, sf), _line_deliveries(spark, sf), products=S.line_products(spark, sf))
    rows = materialize(G.trim_warm_up(grid).where("has_demand = 1"), "demand-rows")
    learned = training.sample_rows(rows, 2 * MODEL["max_rows"])  # half of it are demand rows, and there are no others
    model = M.fit_regressor(learned, features, rounds=MODEL["rounds"], depth=MODEL["regressor_depth"])
    return M.importance(model, features, spark)


# --------------------------------------------------------------- files, streams


def event_file(spark, sf):
    """All events written as a loosely headed CSV file, read back and canonicalised."""
    path = new_shared_path(spark, "event-file")
    S.flow_events(spark, sf).select(
        F.date_format("day", "dd-MM-yyyy").alias("Date"),
        F.col("sku").alias("Produit"),
        F.col("flow_word").alias("Type flux"),
        F.floor("qty").alias("Qty"),
    ).write.option("header", True).csv(path)
    events = files.read_events(spark, path).withColumn("direction", L.direction("flow_word"))
    return events.groupBy("day", "sku", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


def stream_congestion(spark, sf):
    """Movements per day and home zone, counted by a stream over the event files."""
    events = live_ledger.with_sites(movements.event_stream(spark, sf))
    zones = S.slots(spark, sf, "customer").select(F.col("slot_id").alias("sku"), "zone")
    return movements.run_to_table(movements.movements(events, zones))


def stream_ledger(spark, sf):
    """Ledger outcomes computed by a stream over the event files."""
    return live_ledger.run_to_table(live_ledger.ledger(live_ledger.with_sites(movements.event_stream(spark, sf))))


def stream_ledger_keyed(spark, sf):
    """The same outcomes from a keyed state per site and product, whose timers put late events in their place."""
    events, end = keyed_ledger.with_end(live_ledger.ledger(live_ledger.with_sites(movements.event_stream(spark, sf))))
    last = S.flow_events(spark, sf).agg(F.max("ts")).first()[0]
    rows, _ = keyed_ledger.run_to_table(keyed_ledger.ledger(events), (lambda: end(last)) if last else None)
    return rows


QUERIES = {
    f.__name__: f
    for f in (
        tune_threshold, tune_expected_value, tune_daily, tuned_mode, batch_forecast, forecast_summary, forecast_sample,
        forecast_file, forecast_explained, approximate_features, preparation_order, dated_preparation_order, preparation_tour, product_features, train_and_score, model_forecast,
        feature_importance, event_file, stream_congestion, stream_ledger, stream_ledger_keyed,
    )
}
