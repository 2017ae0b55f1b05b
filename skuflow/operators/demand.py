"""Daily demand, deliveries and per-SKU statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions.clean import non_negative
from skuflow.operators.prefix import numbered, running



def daily_demand(history: DataFrame) -> DataFrame:
    """(sku, day, demand): one row per pair, negative totals lifted to 0."""
    return history.groupBy("sku", "day").agg(non_negative(F.sum("qty")).alias("demand"))


def spread_by_sku(daily: DataFrame, partitions: int | None = None) -> DataFrame:
    """Shuffle by SKU into a fixed number of partitions.

    The rows multiply after this shuffle (one per calendar day), so the number
    must fit the dense grid; left alone, adaptive execution would merge
    partitions by the size of the sparse input and serialise the rest.
    """
    n = partitions or int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return daily.repartition(n, "sku")


def capped_daily(daily: DataFrame, q: float = 0.99, fit_until: Column | None = None) -> DataFrame:
    """Limit each SKU's daily demand to its own q-percentile (linear interpolation),
    taken over the days up to ``fit_until`` when given.

    Written as a window, so that later per-SKU windows reuse its shuffle. One
    SKU has at most one row per calendar day here, however hot it is.
    """
    if fit_until is None:
        seen = F.col("demand")
    else:
        daily = daily.withColumn("_until", fit_until)
        seen = F.when(F.col("day") <= F.col("_until"), F.col("demand"))
    cap = F.percentile(seen, F.lit(q)).over(Window.partitionBy("sku"))
    return daily.withColumn("demand", F.least("demand", cap)).select("sku", "day", "demand")


def deliveries(transactions: DataFrame, lines: DataFrame) -> DataFrame:
    """(sku, day, n_deliveries, qty_delivered) over delivery transactions."""
    headers = transactions.where(F.col("transaction_type") == "DELIVERY").select(
        "transaction_id", F.col("created_at").cast("date").alias("day")
    )
    return (
        lines.join(headers, "transaction_id")
        .groupBy("sku", "day")
        .agg(F.count("qty").alias("n_deliveries"), non_negative(F.sum("qty")).alias("qty_delivered"))
    )


def delivery_stats(daily_deliveries: DataFrame) -> DataFrame:
    """Totals per SKU. The input has one row per (sku, day), so days need no distinct count."""
    return daily_deliveries.groupBy("sku").agg(
        F.sum("n_deliveries").alias("del_total_count"),
        F.sum("qty_delivered").alias("del_total_qty"),
        F.count("day").alias("del_n_days"),
        F.avg("qty_delivered").alias("del_avg_qty"),
    )


def sku_stats(daily: DataFrame) -> DataFrame:
    """Mean, median, sample deviation (1 when undefined) and number of demand days."""
    return daily.groupBy("sku").agg(
        F.avg("demand").alias("prod_avg_demand"),
        F.median("demand").alias("prod_med_demand"),
        F.coalesce(F.stddev_samp("demand"), F.lit(1.0)).alias("prod_std_demand"),
        F.count("day").alias("prod_n_days"),
    )


def sku_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("sku").agg(F.sum("demand").alias("total_demand"), F.count("day").alias("n_demand_days"))


def fit_candidates(totals: DataFrame, min_days: int = 10) -> DataFrame:
    """SKUs with enough demand days for a fitted baseline."""
    return totals.where(F.col("n_demand_days") >= min_days).select("sku")


def without_fit(all_skus: DataFrame, fitted: DataFrame) -> DataFrame:
    return all_skus.select("sku").join(fitted.select("sku"), "sku", "left_anti")


def n_days(start, end):
    return F.datediff(end, start) + 1


def demand_frequency(daily: DataFrame, calendar_days) -> DataFrame:
    """Share of calendar days with demand, from the sparse rows (empty days add nothing to the numerator)."""
    return daily.groupBy("sku").agg(
        (F.count_if(F.col("demand") > 0) / calendar_days).alias("demand_freq")
    )


def sparsity_profile(daily: DataFrame) -> DataFrame:
    """One row: grid cells, filled cells, sparsity, SKUs above 5 % and below 1 % frequency."""
    per_sku = daily.groupBy("sku").agg(
        F.count_if(F.col("demand") > 0).alias("filled"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    days = F.datediff(F.max("last_day"), F.min("first_day")) + 1
    # per-SKU counts fold into a histogram of "days with demand", so frequencies need no second pass
    histogram = per_sku.groupBy("filled").agg(
        F.count("sku").alias("skus"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")
    )
    span = histogram.agg(days.alias("n_days")).scalar()
    freq = F.col("filled") / F.col("n_days")
    return (
        histogram.withColumn("n_days", span)
        .groupBy()
        .agg(
            F.sum("skus").alias("n_skus"),
            F.max("n_days").cast("long").alias("n_days"),
            F.sum(F.col("skus") * F.col("n_days")).alias("cells"),
            F.sum(F.col("skus") * F.col("filled")).alias("filled_cells"),
            F.sum(F.when(freq > 0.05, F.col("skus")).otherwise(0)).alias("high_freq_skus"),
            F.sum(F.when(freq < 0.01, F.col("skus")).otherwise(0)).alias("low_freq_skus"),
        )
        .withColumn("sparsity", 1 - F.col("filled_cells") / F.col("cells"))
    )


def segments(daily: DataFrame, share: float = 0.2) -> DataFrame:
    """HF for the top ``share`` of SKUs by demand days (ties by key), LF for the rest.

    The cut is found on counts per number-of-days value, which has at most one
    entry per calendar day; only the SKUs at the cut value are ranked by key.
    """
    days = daily.groupBy("sku").agg(F.count_if(F.col("demand") > 0).alias("demand_days"))
    sizes = days.groupBy("demand_days").agg(F.count("sku").alias("n"))
    above = Window.orderBy(F.desc("demand_days")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cuts = sizes.select(
        "demand_days",
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("ahead"),
        "n",
        F.floor(F.sum("n").over(everything) * share).alias("quota"),
    )
    tied = cuts.where((F.col("ahead") < F.col("quota")) & (F.col("ahead") + F.col("n") > F.col("quota")))
    at_cut = days.join(F.broadcast(tied), "demand_days", "left_semi")
    ranked = numbered(at_cut.select("demand_days", "sku"), [], ["sku"], "pos").select("sku", "pos")
    return (
        days.join(F.broadcast(cuts), "demand_days")
        .join(ranked, "sku", "left")
        .select(
            "sku",
            "demand_days",
            F.when(F.col("ahead") + F.coalesce("pos", "n") <= F.col("quota"), "HF").otherwise("LF").alias("segment"),
        )
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, col: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as one row.

    Equal values fold into counts first; running counts over sorted slices then
    tell which value stands at a position, so no task holds all values.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, [], [col], {"_upto": F.col("_n")})
    ranked = ranked.withColumn("_last", ranked.agg(F.sum("_n") - 1).scalar())

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col(col)))

    ends = []
    for name, q in qs.items():
        place = F.col("_last") * q
        ends += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi")]
    found = ranked.agg(F.max("_last").alias("_last"), *ends)
    part = {n: F.col("_last") * q - F.floor(F.col("_last") * q) for n, q in qs.items()}
    return found.select(
        *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * part[n]).alias(n) for n in qs]
    )


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of one column."""
    c, qs = F.col(col), {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = quantiles(df, col, qs)
    stats = df.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
    )
    return stats.withColumns({q: found.select(q).scalar() for q in qs})
