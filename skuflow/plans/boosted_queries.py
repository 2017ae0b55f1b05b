"""Registered queries on models boosted with second-order gain: forecast of the hold-out, its evaluation, gains."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.functions.clean import even_rounded, rounded
from skuflow.operators import boosting as H
from skuflow.operators import evaluate as E
from skuflow.plans import training
from skuflow.plans.demand_queries import BLENDS, TEST_DAYS
from skuflow.plans.model_queries import _line_deliveries
from skuflow.session import materialize
from skuflow.sources import tables as S

#: All rows teach. Fewer rounds with longer steps than the published settings, so that a query takes minutes.
ROUNDS = {"rounds": 24, "step": 0.15, "patience": 8, "depth": 5}


def _boosted(spark, sf) -> training.Boosted:
    return training.train_boosted(
        S.line_history(spark, sf),
        _line_deliveries(spark, sf),
        replace(H.CLASSIFIER, **ROUNDS),
        replace(H.REGRESSOR, **ROUNDS),
        products=S.line_products(spark, sf),
    )


def boosted_forecast(spark, sf):
    """Forecast of the last 30 days by models that learnt from all rows before, tuned on the 30 days between."""
    cols = ["sku", "day", "demand", "segment", "base_yhat", "probability", "reg_qty"]
    return _boosted(spark, sf).scored_test.select(*cols, even_rounded("pred").alias("pred"))


def hold_out_report(scored: DataFrame, classifier: H.Model, regressor: H.Model, threshold: float, first_day) -> DataFrame:
    """(section, name, measure, value) of a scored hold-out (sku, day, demand, base_yhat, lag_1, ewm_7, probability, reg_qty, pred).

    Sections: ``daily`` (WAPE and bias on demand rows), ``horizon`` (WAPE and bias of ten-day totals), ``classifier``
    (AUC, confusion at the tuned threshold), ``gain_classifier`` and ``gain_regressor`` (15 largest gains).
    """
    spark = scored.sparkSession
    parts = {"baseline": "base_yhat", "regressor": "reg_qty", "lag_1": "lag_1", "ewm_7": "ewm_7", "final": "pred"}
    mixes = {n: {n: 1.0} for n in parts} | {f"blend_{a}": {"baseline": a, "regressor": 1 - a} for a in BLENDS}
    rows = scored.withColumn("actual", F.col("demand"))
    models = {m: sum((F.coalesce(F.col(parts[n]), F.lit(0.0)) * w for n, w in mix.items()), F.lit(0.0)) for m, mix in mixes.items()}
    daily = E.scores(rows, models)
    tagged = E.windowed(rows.withColumn("_first", first_day), F.col("_first"), TEST_DAYS)
    horizon = E.window_model_scores(tagged, {n: F.col(c) for n, c in parts.items()}, mixes)
    labelled = rows.withColumn("label", (F.col("demand") > 0).cast("int"))
    area = E.auc(labelled, score="probability")
    counts = E.confusion(labelled, threshold, score="probability")

    def lines(df: DataFrame, section: str, name, measures: list[str]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.inline(entries))

    out = lines(daily, "daily", F.col("model"), ["wape_dd", "bias_dd", "n_demand"])
    out = out.unionByName(lines(horizon, "horizon", F.col("model"), ["wape_10d", "bias_10d"]))
    out = out.unionByName(lines(area, "classifier", F.lit("auc"), ["auc", "n_pos", "n_neg"]))
    out = out.unionByName(lines(counts, "classifier", F.lit("confusion"), ["tp", "fp", "fn", "tn", "precision", "recall"]))
    for section, model in (("gain_classifier", classifier), ("gain_regressor", regressor)):
        out = out.unionByName(lines(model.gains(spark), section, F.col("feature"), ["gain"]))
    return out.withColumn("value", rounded("value", 6))


def boosted_report(spark, sf):
    """Evaluation of the boosted models on the last 30 days beside baseline, lag and means, and their largest gains."""
    made = _boosted(spark, sf)
    params = made.params.first()
    scored = materialize(made.scored_test, "scored")
    first_day = F.date_sub(scored.agg(F.max("day").alias("d")).scalar(), TEST_DAYS - 1)
    threshold = 0.5 if params["thr"] is None else params["thr"] / 1000.0
    return hold_out_report(scored, made.classifier, made.regressor, threshold, first_day)


QUERIES = {f.__name__: f for f in (boosted_forecast, boosted_report)}
