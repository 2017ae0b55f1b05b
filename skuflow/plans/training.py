"""Feature grid and training pipeline, chained from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions.calendar import calendar_columns
from skuflow.functions.clean import finite_or_zero, flag, number_or
from skuflow.functions.holidays import with_holidays
from skuflow.operators import baseline as B
from skuflow.operators import boosting as H
from skuflow.operators import demand as D
from skuflow.operators import evaluate as E
from skuflow.operators import features as X
from skuflow.operators import grid as G
from skuflow.operators import models as M
from skuflow.operators import scoring as C
from skuflow.operators import tuning as T
from skuflow.session import materialize

NOT_FEATURES = {"sku", "day", "day_no", "epoch", "demand", "has_demand", "segment", "n_deliveries", "qty_delivered"}
# Only the sku-day keys, labels and bookkeeping stay out of the feature vector.


# Names of the physical attributes and of the priority columns.
PHYSICAL = ["colisage_fardeau", "colisage_palette", "volume_pcs", "poids_kg", "is_gerbable"]
PRIORITY = ["p_total", "p_days", "p_avg", "p_freq", "p_prio", "p_demand_score", "p_freq_score"]


def sku_dimension(
    daily: DataFrame, daily_deliveries: DataFrame, days: DataFrame, start: Column, products: DataFrame | None = None
) -> DataFrame:
    """Everything constant per SKU: statistics, delivery totals, segment, baseline fit, attributes, priorities.

    ``products``: sku, category and the physical attributes, one row per SKU; what is missing is 0 or UNKNOWN.
    """
    seg = D.segments(daily).select("sku", "segment", (F.col("segment") == "HF").cast("double").alias("is_hf"))
    dim = (
        D.sku_stats(daily)
        .join(D.delivery_stats(daily_deliveries), "sku", "left")
        .join(seg, "sku", "left")
        .join(B.fitted_dimension(daily, days, start), "sku", "left")
        .join(priorities(daily, days), "sku", "left")
    )
    if products is None:
        dim = dim.withColumns({c: F.lit(0.0) for c in (*PHYSICAL, "cat_enc")})
    else:
        dim = dim.join(product_features(products), "sku", "left")
    return dim.fillna(
        0, ["del_total_count", "del_total_qty", "del_n_days", "del_avg_qty", "is_hf", *PHYSICAL, *PRIORITY, "cat_enc"]
    ).fillna("LF", ["segment"])


def product_features(products: DataFrame) -> DataFrame:
    """(sku, cat_enc, physical attributes as numbers)."""
    named = products.withColumn("category", F.coalesce("category", F.lit("UNKNOWN")))
    coded = named.join(X.category_codes(products), "category", "left")
    numbers = [number_or(c, 0.0).alias(c) for c in PHYSICAL[:-1]] + [flag(PHYSICAL[-1]).alias(PHYSICAL[-1])]
    return coded.select("sku", "cat_enc", *numbers)


def priorities(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Demand totals, days, mean, frequency, and their scores.

    The published priority table is an input file whose scores are not explained; here a score is the share of the
    largest value and the priority the mean of both scores.
    """
    n_days = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    sold = F.col("demand") > 0
    per_sku = daily.groupBy("sku").agg(
        F.sum("demand").alias("p_total"),
        F.count_if(sold).cast("double").alias("p_days"),
        F.coalesce(F.avg(F.when(sold, F.col("demand"))), F.lit(0.0)).alias("p_avg"),
    ).withColumn("p_freq", F.col("p_days") / n_days)
    tops = per_sku.agg(F.max("p_total").alias("t"), F.max("p_freq").alias("f"))
    scored = per_sku.crossJoin(F.broadcast(tops)).withColumns(  # one row
        {
            "p_demand_score": F.coalesce(F.try_divide("p_total", "t"), F.lit(0.0)),
            "p_freq_score": F.coalesce(F.try_divide("p_freq", "f"), F.lit(0.0)),
        }
    )
    return scored.withColumn("p_prio", (F.col("p_demand_score") + F.col("p_freq_score")) / 2).select("sku", *PRIORITY)


STATIC = ["prod_avg_demand", "prod_med_demand", "prod_std_demand", "prod_n_days", "del_total_count",
          "del_total_qty", "del_n_days", "del_avg_qty", "is_hf", "segment", *PHYSICAL, *PRIORITY, "cat_enc"]


TIME_SERIES = [X.LAG, X.SAME_WEEKDAY, X.MOMENTS, X.EXTREMES, X.SUMS, X.MEDIANS, X.FREQUENCY, X.DAYS_SINCE, X.EWM,
               X.DELIVERY_ROLLING]
DERIVED = [[X.RATIOS[-1]], [X.BASELINE[-1]]]


def feature_grid(
    history: DataFrame,
    daily_deliveries: DataFrame,
    holdout_days: int = 60,
    extend_days: int = 0,
    products: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Dense feature grid and its feature names.

    The demand cap, the statistics, the delivery totals, the priorities and the
    baseline see only the days before the hold-out. ``extend_days`` appends empty days after the history (for scoring).
    """
    spark = history.sparkSession
    start, last = G.day_bounds(history)
    until = F.date_sub(last, holdout_days)
    daily = materialize(D.capped_daily(D.daily_demand(history), fit_until=until), "daily")
    fit_days = G.calendar(start, until, spark)
    fit_rows = daily.withColumn("_u", until).where("day <= _u").drop("_u")
    fit_deliveries = daily_deliveries.withColumn("_u", until).where("day <= _u").drop("_u")
    dim = materialize(sku_dimension(fit_rows, fit_deliveries, fit_days, start, products), "sku-dimension")

    end = F.date_add(last, extend_days)
    facts = G.merge_facts(daily, daily_deliveries, start, last)
    fit = dim.select("sku", *B.FIT_COLUMNS)
    sparse = D.spread_by_sku(facts.join(fit, "sku", "left"))
    grid = G.demand_grid(sparse, start, end, ("demand", "n_deliveries", "qty_delivered"), B.FIT_COLUMNS)
    all_days = G.calendar(start, end, spark)

    # windows run on narrow rows; what is constant per SKU or per day is added after them
    grid = with_baseline(grid, all_days, start)
    grid = X.add(grid, *TIME_SERIES, [X.BASELINE[0]]).drop("days_since_last")
    grid = grid.join(dim.select("sku", *STATIC), "sku", "left")
    grid = grid.withColumns(
        {c: F.coalesce(c, F.lit(1)) for c in ("prod_avg_demand", "prod_med_demand", "prod_std_demand", "prod_n_days")}
    )
    grid = with_holidays(X.add(grid, *DERIVED), all_days)
    grid = grid.withColumns(calendar_columns("day")).withColumns(
        {"day_idx": F.col("day_no").cast("double"), "day_idx_sq": F.pow("day_no", F.lit(2)) / 1e6}
    )
    grid = grid.drop("is_first_of_month", "is_last_of_month").transform(X.hf_interactions)
    grid = finite_or_zero(grid)
    return grid, sorted(c for c in grid.columns if c not in NOT_FEATURES)


def with_baseline(grid: DataFrame, days: DataFrame, start: Column) -> DataFrame:
    """Baseline columns from the fit columns each row carries; these are dropped afterwards."""
    cal = B.class_calendar(days, start).select("day", "t", *B.LEVELS)
    return B.components(grid.join(F.broadcast(cal), "day", "left")).drop(*B.FIT_COLUMNS, "t", *B.LEVELS)


@dataclass
class Trained:
    classifier: PipelineModel
    regressor: PipelineModel
    features: list[str]
    params: DataFrame
    scored_test: DataFrame


def train(
    history: DataFrame,
    daily_deliveries: DataFrame,
    rounds: int = 60,
    classifier_depth: int = 7,
    regressor_depth: int = 6,
    valid_days: int = 30,
    test_days: int = 30,
    products: DataFrame | None = None,
    max_rows: int | None = None,
) -> Trained:
    """Train on the past, tune on the validation days, score the test days.

    ``max_rows`` bounds the labelled rows each model learns from: those with the smallest hashes of their keys, of the
    demand rows and of the others in equal parts (the weights even that out). Tuning and scoring see all rows.

    The grid is written once and read by both models, the tuning and the scoring.
    """
    grid, features = feature_grid(history, daily_deliveries, holdout_days=valid_days + test_days, products=products)
    grid = materialize(G.trim_warm_up(grid), "features")
    last = grid.agg(F.max("day").alias("d")).scalar()
    known, test = G.train_test(grid, last, test_days)
    fit_part, valid = G.train_test(known, F.date_sub(last, test_days), valid_days)

    learn_from, stop_by = (fit_part, valid) if max_rows is None else (sample_rows(fit_part, max_rows), sample_rows(valid, max_rows))
    weighted = M.class_weight(learn_from.withColumn("is_valid", F.lit(False))).unionByName(
        stop_by.withColumns({"is_valid": F.lit(True), "weight": F.lit(1.0)})
    )
    if max_rows is not None:
        weighted = materialize(weighted, "learn")
    classifier = M.fit_classifier(weighted, features, rounds, classifier_depth, validation="is_valid")
    regressor = M.fit_regressor(weighted, features, rounds, regressor_depth, validation="is_valid")

    keys = ["sku", "day", "demand", "segment", "base_yhat", "ewm_7", "lag_1"]

    def score(part: DataFrame) -> DataFrame:
        return M.with_predictions(part, classifier, regressor).select(*keys, "probability", "reg_qty")

    tuned_on = materialize(as_eval(score(valid), valid_days), "valid")
    params = T.choose_mode(T.tune_threshold(tuned_on), T.tune_expected_value(tuned_on))
    chosen = params.first()
    scored = score(test).withColumn("pred", M.final_prediction(chosen))
    return Trained(classifier, regressor, features, params, scored)


@dataclass
class Boosted:
    classifier: H.Model
    regressor: H.Model
    params: DataFrame
    scored_test: DataFrame


def train_boosted(
    history: DataFrame,
    daily_deliveries: DataFrame,
    classifier: H.Settings = H.CLASSIFIER,
    regressor: H.Settings = H.REGRESSOR,
    valid_days: int = 30,
    test_days: int = 30,
    products: DataFrame | None = None,
) -> Boosted:
    """Second-order boosting on all rows before the validation days, which stop it; tuned there, scored on the test days."""
    grid, features = feature_grid(history, daily_deliveries, holdout_days=valid_days + test_days, products=products)
    grid = materialize(G.trim_warm_up(grid), "features")
    last = grid.agg(F.max("day").alias("d")).scalar()
    known, test = G.train_test(grid, last, test_days)
    fit_part, valid = G.train_test(known, F.date_sub(last, test_days), valid_days)
    # what stops the training weighs as it is
    learn = M.class_weight(fit_part).withColumn("is_valid", F.lit(False)).unionByName(valid.withColumns({"is_valid": F.lit(True), "weight": F.lit(1.0)}))
    quantity = learn.where("demand > 0").withColumn("log_demand", M.log_target("demand"))
    occurs = H.fit(learn, features, "has_demand", classifier, weight="weight", valid="is_valid")
    amount = H.fit(quantity, features, "log_demand", regressor, valid="is_valid")

    keys = ["sku", "day", "demand", "segment", "base_yhat", "ewm_7", "lag_1"]

    def score(part: DataFrame) -> DataFrame:
        both = amount.predict(occurs.predict(part, "probability"), "_log")
        return both.withColumn("reg_qty", M.unlog_target("_log")).select(*keys, "probability", "reg_qty")

    tuned_on = materialize(as_eval(score(valid), valid_days), "valid")
    params = T.choose_mode(T.tune_threshold(tuned_on), T.tune_expected_value(tuned_on))
    scored = score(test).withColumn("pred", M.final_prediction(params.first()))
    return Boosted(occurs, amount, params, scored)


def sample_rows(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows, half of them with demand where there are so many; chosen by a hash of the keys."""
    place = F.pmod(F.xxhash64("sku", "day"), F.lit(1 << 30)) / float(1 << 30)
    counts = {r["has_demand"]: r["count"] for r in rows.groupBy("has_demand").count().collect()}
    share = F.lit(0.0)
    for label, count in counts.items():
        share = F.when(F.col("has_demand") == label, F.lit(min(1.0, n / 2 / count))).otherwise(share)
    return rows.where(place < share)


def forecast(spark, path: str, features: list[str], first: Column, last: Column) -> DataFrame:
    """Score the days from ``first`` to ``last`` with the models saved below ``path`` (see ``models.save``).

    The saved dimension holds one row per SKU with what ``scoring.approximate_features`` needs.
    """
    classifier, regressor, dimension, params = M.load(spark, path)
    rows = with_holidays(C.forecast_rows(dimension, first, last), G.calendar(first, last, spark))
    scored = M.with_predictions(C.approximate_features(rows, features), classifier, regressor)
    return scored.withColumn("pred", M.final_prediction(params.first()))


def as_eval(scored: DataFrame, n_days: int, horizon: int = 10) -> DataFrame:
    """Columns the tuning reads: win, sku, actual, base, reg, ewm, p."""
    first = scored.agg(F.min("day").alias("d")).scalar()
    rows = scored.withColumn("_first", first)
    tagged = E.windowed(rows, F.col("_first"), n_days, horizon)
    return tagged.select(
        "win",
        "sku",
        F.col("demand").alias("actual"),
        F.col("base_yhat").alias("base"),
        F.col("reg_qty").alias("reg"),
        F.coalesce("ewm_7", F.lit(0.0)).alias("ewm"),
        F.col("probability").alias("p"),
    )
