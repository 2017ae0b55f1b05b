"""Readers that shape the star-schema tables into the engine's roles.

Day values are moved forward by 28 years: the civil calendar repeats exactly
after 28 years within 1901-2099 (same weekdays, same leap days), which brings
the order history into the years the holiday calendar covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALENDAR_SHIFT_YEARS = 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shifted_day(ts: Column | str) -> Column:
    return F.add_months(F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date"), 12 * CALENDAR_SHIFT_YEARS)


def demand_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand per part: (sku BIGINT, day, qty)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("sku"), shifted_day("l_shipdate").alias("day"), F.col("l_quantity").alias("qty")
    )


def line_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand per product line (brand and type), the modelling key: (sku STRING, day, qty)."""
    part = table(spark, sf_dir, "part").select("p_partkey", product_line_key().alias("line"))
    return (
        demand_history(spark, sf_dir)
        .join(part, F.col("sku") == F.col("p_partkey"))
        .select(F.col("line").alias("sku"), "day", "qty")
    )


def product_line_key() -> Column:
    return F.concat_ws("|", "p_brand", "p_type")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers; status F plays the delivery type."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.when(F.col("o_orderstatus") == "F", "DELIVERY").otherwise(F.col("o_orderstatus")).alias("transaction_type"),
        F.col("o_orderdate").alias("created_at"),
    )


def transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("qty")
    )


def line_transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction lines with the product line as SKU."""
    part = table(spark, sf_dir, "part").select("p_partkey", product_line_key().alias("line"))
    return (
        transaction_lines(spark, sf_dir)
        .join(part, F.col("sku") == F.col("p_partkey"))
        .select("transaction_id", F.col("line").alias("sku"), "qty")
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension; weight in kg."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sku"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        (F.col("p_size") / 5.0).alias("weight_kg"),
        F.col("p_retailprice").alias("price"),
    )


def line_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes per product line, from its parts: pack and pallet sizes, volume, weight, stackable."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(product_line_key().alias("sku"))
        .agg(
            F.max("p_type").alias("category"),
            F.max("p_size").cast("double").alias("colisage_fardeau"),
            F.sum("p_size").cast("double").alias("colisage_palette"),
            F.round(F.max("p_retailprice") / 100, 4).alias("volume_pcs"),
            (F.max("p_size") / 5.0).alias("poids_kg"),
            (F.min("p_size") % 2 == 0).cast("string").alias("is_gerbable"),
        )
    )


SLOT_KEYS = {"supplier": "s_suppkey", "customer": "c_custkey"}


def slots(spark: SparkSession, sf_dir: str, source: str = "supplier") -> DataFrame:
    """Warehouse slots laid out from the keys of a table: 20 x 10 columns, five levels, four sites."""
    sid = F.col(SLOT_KEYS[source])
    z = F.pmod((sid / 20).cast("long"), F.lit(5))
    base = table(spark, sf_dir, source).select(
        sid.alias("slot_id"),
        F.pmod(sid, F.lit(4)).alias("site"),
        F.pmod(sid, F.lit(20)).alias("x"),
        F.pmod((sid / 100).cast("long"), F.lit(10)).alias("y"),
        z.alias("z"),
    )
    zone = (
        F.when(F.col("z") == 0, F.lit("B7-PCK"))
        .when(F.col("z") == 4, F.lit("B07-SS"))
        .otherwise(F.concat(F.lit("B07-N"), F.col("z").cast("string")))
    )
    return base.select(
        "*",
        F.concat_ws("-", F.lit("S"), "x", "y", "z", "slot_id").alias("code"),
        zone.alias("zone"),
        F.concat(F.lit("C"), F.col("x").cast("string")).alias("floor"),
        F.when(F.col("z") == 0, "PICKING").otherwise("RESERVE").alias("slot_type"),
        (F.abs(F.col("x") - 3) + F.abs(F.col("y") - 5) + F.col("z")).cast("double").alias("dist"),
    )


def flow_word() -> Column:
    """Event kinds as the flow words people write."""
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "Reception ")
        .when(kind == "click", "IN")
        .when(kind == "purchase", "Sortie")
        .when(kind == "view", " outgoing")
        .otherwise(kind)
    )


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse movements from the event log, flow words still raw."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts"),
        F.col("ts").cast("date").alias("day"),
        F.col("user_id").alias("sku"),
        F.pmod("user_id", F.lit(4)).alias("site"),
        flow_word().alias("flow_word"),
        F.col("value").alias("qty"),
    )


def pick_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to pick per order; the slot is the line's supplier."""
    part = products(spark, sf_dir).select("sku", "weight_kg")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("long").alias("line_no"),
            F.col("l_partkey").alias("sku"),
            F.col("l_suppkey").alias("slot_id"),
            F.col("l_quantity").alias("qty"),
        )
        .join(part, "sku", "left")
    )
