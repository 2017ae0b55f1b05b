"""Forecast metrics: WAPE, bias, window aggregation, AUC, confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.operators.prefix import running


def wape(actual: str = "actual", pred: str = "pred") -> Column:
    return F.try_divide(F.sum(F.abs(F.col(actual) - F.col(pred))), F.sum(actual)) * 100


def bias(actual: str = "actual", pred: str = "pred") -> Column:
    return F.try_divide(F.sum(pred) - F.sum(actual), F.sum(actual)) * 100


def long_models(rows: DataFrame, models: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per (row, model): (keep..., model, pred). The list of models is fixed and short."""
    entries = F.array(
        *[F.struct(F.lit(m).alias("model"), F.coalesce(c, F.lit(0.0)).alias("pred")) for m, c in models.items()]
    )
    return rows.select(*keep, F.inline(entries))


def scores(rows: DataFrame, models: dict[str, Column]) -> DataFrame:
    """WAPE and bias per model over demand rows and over all rows: one pass, models are expanded after it."""
    actual = F.col("actual")
    demand_row = actual > 0
    aggs = [F.sum("actual").alias("_a"), F.sum(F.when(demand_row, actual)).alias("_ad"), F.count_if(demand_row).alias("n_demand"), F.count(F.lit(1)).alias("n_rows")]
    for i, pred in enumerate(models.values()):
        p = F.coalesce(pred, F.lit(0.0))
        aggs += [F.sum(F.abs(actual - p)).alias(f"_e{i}"), F.sum(p).alias(f"_p{i}")]
        aggs += [F.sum(F.when(demand_row, F.abs(actual - p))).alias(f"_ed{i}"), F.sum(F.when(demand_row, p)).alias(f"_pd{i}")]
    lines = [
        F.struct(F.lit(m).alias("model"), *[F.col(f"_{k}{i}").alias(k) for k in ("e", "p", "ed", "pd")]) for i, m in enumerate(models)
    ]
    sums = rows.agg(*aggs).select("_a", "_ad", "n_demand", "n_rows", F.inline(F.array(*lines)))
    return sums.select(
        "model",
        (F.try_divide("ed", "_ad") * 100).alias("wape_dd"),
        (F.try_divide(F.col("pd") - F.col("_ad"), F.col("_ad")) * 100).alias("bias_dd"),
        (F.try_divide("e", "_a") * 100).alias("wape_grid"),
        (F.try_divide(F.col("p") - F.col("_a"), F.col("_a")) * 100).alias("bias_grid"),
        "n_demand",
        "n_rows",
    )


def windowed(rows: DataFrame, first_day: Column, n_days: int, horizon: int = 10) -> DataFrame:
    """Tag rows with their evaluation window. Left-over days after the last full
    window are dropped; fewer days than one horizon make a single window."""
    win = F.floor(F.datediff("day", first_day) / horizon)
    full = max(1, n_days // horizon)
    return rows.withColumn("win", win).where(F.col("win") < full)


def window_sums(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (group, window, SKU) totals, demand only."""
    return (
        rows.groupBy(*by, "win", "sku")
        .agg(F.sum("actual").alias("actual"), F.sum("pred").alias("pred"))
        .where(F.col("actual") > 0)
    )


def window_scores(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """WAPE and bias of the horizon totals."""
    return window_sums(rows, by).groupBy(*by).agg(wape().alias("wape_10d"), bias().alias("bias_10d"))


def window_model_scores(rows: DataFrame, parts: dict[str, Column], models: dict[str, dict[str, float]]) -> DataFrame:
    """WAPE and bias of horizon totals per model. A model is a weighted sum of ``parts``, so rows fold to one line per
    (window, SKU) with a sum per part, and models are expanded over those lines."""
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(f"_{n}") for n, c in parts.items()]
    lines = rows.groupBy("win", "sku").agg(F.sum("actual").alias("actual"), *sums).where("actual > 0")
    preds = {m: sum((F.col(f"_{n}") * w for n, w in mixed.items()), F.lit(0.0)) for m, mixed in models.items()}
    return long_models(lines, preds, ["actual"]).groupBy("model").agg(wape().alias("wape_10d"), bias().alias("bias_10d"))


def segment_scores(rows: DataFrame) -> DataFrame:
    """Per segment and overall in one pass (grouping sets)."""
    demand = rows.where(F.col("actual") > 0)
    return demand.rollup("segment").agg(
        wape().alias("wape_dd"), bias().alias("bias_dd"), F.count(F.lit(1)).alias("n_demand")
    ).withColumn("segment", F.coalesce("segment", F.lit("ALL")))


def auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC: share of (positive, negative) pairs in the right order, ties count half.

    Equal scores fold first; the running number of negatives is taken over
    sorted slices, so any number of distinct scores works.
    """
    per_score = rows.groupBy(score).agg(
        F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg")
    )
    ranked = running(per_score, [], [score], {"neg_upto": F.col("neg")})
    below = F.col("neg_upto") - F.col("neg") / 2
    return ranked.agg(
        F.try_divide(F.sum(F.col("pos") * below), F.sum("pos") * F.sum("neg")).alias("auc"),
        F.sum("pos").cast("long").alias("n_pos"),
        F.sum("neg").cast("long").alias("n_neg"),
    )


def confusion(rows: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Counts, precision and recall of score >= threshold."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    counts = rows.agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )
    return counts.withColumns(
        {
            "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)),
            "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)),
        }
    )
