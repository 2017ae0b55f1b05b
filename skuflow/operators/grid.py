"""Calendar grid: every SKU gets one row per day, empty days filled with 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skuflow.operators.prefix import spread as dealt

# Rows of one SKU are split into epochs of this many days. Sorting by (epoch,
# day) is the same as sorting by day, and lets the exponentially weighted mean
# restart its powers per epoch without another sort.
EPOCH_DAYS = 1024

def by_sku_day() -> WindowSpec:
    return Window.partitionBy("sku").orderBy("epoch", "day")


def day_bounds(history: DataFrame) -> tuple[Column, Column]:
    """First and last day as scalar subqueries over the day column only."""
    span = history.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return span.select("lo").scalar(), span.select("hi").scalar()


def densify(
    sparse: DataFrame,
    start: Column,
    end: Column,
    measures: Sequence[str] = ("demand",),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Fill the gaps between a SKU's rows; only the sparse rows are shuffled.

    Each sparse row emits itself and the empty days up to the SKU's next row;
    the first row also emits the days since ``start``. So the dense grid is made
    inside the tasks that already hold the SKU: no SKU x calendar product, no
    join back. ``carry`` columns are per-SKU constants repeated on every row.
    ``sparse`` holds one row per (sku, day) with ``start <= day <= end``.
    """
    w = Window.partitionBy("sku").orderBy("day")
    bounded = sparse.withColumns({"_start": start, "_end": end})
    runs = bounded.withColumns(
        {
            "_from": F.when(F.lag("day").over(w).isNull(), F.col("_start")).otherwise(F.col("day")),
            "_to": F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("_end")),
        }
    )
    cells = runs.withColumn("_cell", F.explode(F.sequence("_from", "_to")))
    own = F.col("_cell") == F.col("day")
    idx = F.datediff("_cell", "_start")
    return cells.select(
        "sku",
        F.col("_cell").alias("day"),
        idx.alias("day_no"),
        F.floor(idx / EPOCH_DAYS).cast("int").alias("epoch"),
        *[F.when(own, F.coalesce(m, F.lit(0.0))).otherwise(F.lit(0.0)).alias(m) for m in measures],
        *carry,
    )


def fact_cells(
    sparse: DataFrame,
    start: Column,
    end: Column,
    measures: Sequence[str] = ("demand",),
    carry: Sequence[str] = (),
) -> DataFrame:
    """The cells of ``densify`` that hold a row of ``sparse``, with the same columns and ``_before``.

    A SKU that also has a row without a day has its empty days before the first dated one twice in the dense grid (or
    two, if there are none): ``_before`` counts these, as rows that frames and lags there can reach.
    """
    whole = Window.partitionBy("sku")
    placed = sparse.withColumn("_start", start).withColumns(
        {"_undated": F.max(F.col("day").isNull()).over(whole), "_lead": F.datediff(F.min("day").over(whole), "_start")}
    )
    placed = placed.where(F.col("day").between(F.col("_start"), end))
    before = F.when(F.col("_undated"), F.when(F.col("_lead") > 0, F.col("_lead")).otherwise(2)).otherwise(0)
    idx = F.datediff("day", "_start")
    return placed.select(
        "sku",
        "day",
        idx.alias("day_no"),
        F.floor(idx / EPOCH_DAYS).cast("int").alias("epoch"),
        *[F.coalesce(m, F.lit(0.0)).alias(m) for m in measures],
        before.alias("_before"),
        *carry,
    )


def demand_grid(
    sparse: DataFrame,
    start: Column,
    end: Column,
    measures: Sequence[str] = ("demand",),
    carry: Sequence[str] = (),
    empty_days: bool = True,
) -> DataFrame:
    """The grid with every day of a SKU; without ``empty_days`` only the cells that hold facts, for the groups of
    ``sparse_features``, which count the others."""
    cells = densify if empty_days else fact_cells
    return cells(sparse, start, end, measures, carry).withColumn("has_demand", (F.col("demand") > 0).cast("int"))


def recent_grid(daily: DataFrame, start: Column, end: Column, n_days: int, decay: dict[str, float], carry: Sequence[str] = ()) -> DataFrame:
    """Dense grid of the last ``n_days`` days of the history for all SKUs, with exponential means that know the rest.

    The days before are folded to one decayed sum per SKU and entry of ``decay`` (output name -> share kept per day);
    only the asked days become dense, after SKUs were dealt to tasks by the number of dense rows. ``day_no`` still counts from ``start``. ``carry`` names columns of ``daily`` that
    are constant per SKU.
    """
    spread = daily.withColumns({"_end": end, "_start": start})
    spread = spread.withColumn("_from", F.greatest(F.date_sub("_end", n_days - 1), F.col("_start")))
    recent = F.col("day") >= F.col("_from")
    past = {n: F.when(~recent, F.col("demand") * F.pow(F.lit(q), F.datediff("_from", "day") - 1)) for n, q in decay.items()}
    per_sku = spread.groupBy("sku").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_past_{n}") for n, c in past.items()],
        *[F.first(c).alias(c) for c in carry],
        F.first("_from").alias("_from"),
        F.first("_end").alias("_until"),
        F.first("_start").alias("_start"),
        F.collect_list(F.when(recent, F.struct("day", "demand"))).alias("_days"),  # n_days at most
    )
    skus = daily.agg(F.approx_count_distinct("sku")).first()[0]
    per_sku = dealt(per_sku, ["sku"], skus * n_days)
    known = F.map_from_entries(F.filter("_days", lambda d: d.isNotNull()))
    days = per_sku.select("*", known.alias("_known")).select("*", F.explode(F.sequence("_from", "_until")).alias("day"))
    dense = days.withColumns(
        {"demand": F.coalesce(F.element_at("_known", F.col("day")), F.lit(0.0)), "day_no": F.datediff("day", "_start")}
    )
    in_grid = F.datediff("day", "_from")
    before = Window.partitionBy("sku").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    cols: dict[str, Column] = {"lag_1": F.lag("demand", 1).over(Window.partitionBy("sku").orderBy("day"))}
    for n, q in decay.items():
        sums = F.coalesce(F.sum(F.col("demand") * F.pow(F.lit(1 / q), in_grid)).over(before), F.lit(0.0)) * F.pow(F.lit(q), in_grid - 1)
        total = sums + F.col(f"_past_{n}") * F.pow(F.lit(q), in_grid)
        cols[n] = F.when(F.col("day_no") > 0, total * (1 - q) / (1 - F.pow(F.lit(q), F.col("day_no"))))
    out = dense.withColumns(cols).withColumn("has_demand", (F.col("demand") > 0).cast("int"))
    return out.select("sku", "day", "day_no", "demand", "has_demand", *cols, *carry)


def merge_facts(daily: DataFrame, daily_deliveries: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sparse (sku, day, demand, n_deliveries, qty_delivered) for the SKUs and days of the demand history.

    Both facts are sparse, so they are combined before the gaps are filled
    (union and one aggregation) instead of being joined to the dense grid.
    """
    none = F.lit(None).cast("double")
    facts = (
        daily.select("sku", "day", "demand", none.alias("n_deliveries"), none.alias("qty_delivered"))
        .unionByName(
            daily_deliveries.select(
                "sku",
                "day",
                none.alias("demand"),
                F.col("n_deliveries").cast("double").alias("n_deliveries"),
                "qty_delivered",
            )
        )
        .groupBy("sku", "day")
        .agg(*[F.sum(c).alias(c) for c in ("demand", "n_deliveries", "qty_delivered")])
    )
    return (
        facts.withColumns({"_lo": start, "_hi": end})
        .where(F.col("day").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_n", F.count("demand").over(Window.partitionBy("sku")))
        .where("_n > 0")
        .drop("_lo", "_hi", "_n")
    )


def calendar(start: Column, end: Column, spark) -> DataFrame:
    """One row per day; at most a few thousand rows for any history."""
    return spark.range(1).select(start.alias("_s"), end.alias("_e")).select(F.explode(F.sequence("_s", "_e")).alias("day"))


def trim_warm_up(grid: DataFrame, days: int = 60) -> DataFrame:
    return grid.where(F.col("day_no") >= days)


def train_test(grid: DataFrame, last_day: Column, test_days: int = 30) -> tuple[DataFrame, DataFrame]:
    cut = F.date_sub(last_day, test_days)
    return grid.where(F.col("day") <= cut), grid.where(F.col("day") > cut)
