"""Registered queries on files at the edges: keyed JSON, event files with mixed headers, instruction files, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions import labels as L
from skuflow.functions.clean import rounded
from skuflow.operators import demand as D
from skuflow.operators import outcomes as O
from skuflow.plans.demand_queries import by_part
from skuflow.plans.warehouse_queries import _booked
from skuflow.session import new_shared_path
from skuflow.sources import files, versions
from skuflow.sources import tables as S
from skuflow.sources.keyed_json import read_keyed_json, write_keyed_json

#: The older of two published versions knows the history without its last year.
YEAR = 365


def keyed_parameters(spark, sf):
    """Nested attributes of every product written as JSON objects keyed by product, and read back in pieces."""
    path = new_shared_path(spark, "parameters")
    nested = S.products(spark, sf).select(
        "sku", F.struct("category", "brand").alias("names"), F.struct("weight_kg", "price").alias("numbers")
    )
    write_keyed_json(nested, path, "sku")
    schema = "names struct<category: string, brand: string>, numbers struct<weight_kg: double, price: double>"
    back = read_keyed_json(spark, path, schema)
    return back.select(F.col("key").cast("long").alias("sku"), "value.names.*", "value.numbers.*")


def mixed_event_files(spark, sf):
    """All events written in three layouts into one folder, read each by its own header, and canonicalised."""
    path = new_shared_path(spark, "mixed-events")
    events = S.flow_events(spark, sf)
    day, qty = F.date_format("day", "dd-MM-yyyy"), F.floor("qty")
    layouts = [
        [day.alias("Date"), F.col("sku").alias("Produit"), F.col("flow_word").alias("Type flux"), qty.alias("Qty")],
        [qty.alias("Quantite"), F.col("event_id").alias("note"), F.col("flow_word").alias("Flow"), F.col("sku").alias(" Product ID"), F.col("day").alias("DATE")],
        [F.col("sku").alias("product_id"), qty.alias("quantity"), F.col("day").alias("event date"), F.col("flow_word").alias("flow_type")],
    ]
    for n, columns in enumerate(layouts):
        part = events.where(F.pmod("event_id", F.lit(len(layouts))) == n)
        part.select(*columns).write.mode("append").option("header", True).csv(path)
    read = files.read_events(spark, path).withColumn("direction", L.direction("flow_word"))
    return read.groupBy("day", "sku", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


def instruction_file(spark, sf):
    """Instructions of all events written as CSV files and read back: how often each occurs."""
    path = new_shared_path(spark, "instructions")
    files.write_instructions(O.instructions(_booked(spark, sf)), path)
    back = files.dimension_csv(spark, path, "Product bigint, Action string, Location string, Route string, Reason string")
    return back.groupBy(*back.columns).agg(F.count(F.lit(1)).alias("n"))


def published_totals(spark, sf):
    """Product totals published twice: a reader that holds the older version beside one that asks for the current one."""
    d = by_part(spark, sf).shared()
    root = new_shared_path(spark, "published")

    def publish(daily):
        versions.publish(spark, root, lambda path: D.sku_totals(daily).write.parquet(f"{path}/totals"))
        return spark.read.parquet(f"{versions.current(spark, root)}/totals")

    held = publish(d.daily.where(F.col("day") <= F.date_sub(d.end, YEAR)))
    now = publish(d.daily)
    before = held.select("sku", F.col("total_demand").alias("total_before"), F.col("n_demand_days").alias("days_before"))
    both = now.join(before, "sku", "left")
    return both.select("sku", *[rounded(c).alias(c) for c in ("total_demand", "total_before")], "n_demand_days", "days_before")


QUERIES = {f.__name__: f for f in (keyed_parameters, mixed_event_files, instruction_file, published_totals)}
