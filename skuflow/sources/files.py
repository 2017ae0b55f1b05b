"""CSV at the edges: dimension files, event files with loose headers, result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.functions.clean import day_first, flag, number_or, whole_number_or
from skuflow.sources.headers import header_files

# Header fragments of an event file, first match wins.
HEADER_RULES = [
    (("date",), "date"),
    (("product", "produit"), "product_id"),
    (("flow", "type"), "flow_type"),
    (("quantit", "qty"), "quantity"),
]
REQUIRED = ["date", "product_id", "flow_type", "quantity"]


def header_names(columns: list[str]) -> dict[str, str]:
    """Given header -> standard name; only metadata, checked before any job runs."""
    found: dict[str, str] = {}
    for c in columns:
        plain = c.strip().lower().replace(" ", "_")
        name = next((n for marks, n in HEADER_RULES if any(m in plain for m in marks)), None)
        if name is not None:
            found[c] = name
    missing = [n for n in REQUIRED if n not in found.values()]
    if missing:
        raise ValueError(f"missing columns {missing} in {columns}")
    return found


def dimension_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def _layout(columns: tuple[str, ...]) -> tuple[str, ...]:
    """Standard names by position; other columns, and later ones of the same name, are c0, c1, ..."""
    names = header_names(list(columns))
    found: list[str] = []
    for i, c in enumerate(columns):
        name = names.get(c, f"c{i}")
        found.append(f"c{i}" if name in found else name)
    return tuple(found)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files -> (day, sku, flow_word, qty); unreadable numbers become 0.

    Files may differ in the names, order and number of their columns: each file is read by its own header, in one scan
    per layout. A header without a required column is an error, and so is a path without any header. Files without any
    line have no events. The first of several columns that go by one name is read.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    for columns, found in header_files(spark, path).items():
        layouts.setdefault(_layout(columns), []).extend(found)
    if not layouts:
        raise ValueError(f"no event file with a header below {path}")
    return reduce(DataFrame.unionByName, [_events_of(spark, path, names, layouts[names]) for names in sorted(layouts)])


def _events_of(spark: SparkSession, path: str, names: tuple[str, ...], found: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.where(F.col("_metadata.file_path").isin(found)).select(
        day_first("date").alias("day"),
        whole_number_or("product_id", 0).alias("sku"),
        F.col("flow_type").alias("flow_word"),
        whole_number_or("quantity", 0).alias("qty"),
    )


def clean_products(raw: DataFrame) -> DataFrame:
    """Pack sizes default to 1, volume and weight to 0, the stackable flag to 0."""
    return raw.select(
        "sku",
        "category",
        number_or("pack_bundle", 1).alias("pack_bundle"),
        number_or("pack_pallet", 1).alias("pack_pallet"),
        number_or("unit_volume", 0).alias("unit_volume"),
        number_or("weight_kg", 0).alias("weight_kg"),
        flag("stackable").alias("stackable"),
    )


def write_forecast(forecast: DataFrame, path: str, style: str = "iso", by_day: bool = False) -> None:
    """(day, sku, pred) to CSV. "iso": header date, ISO dates; "day_first": header Date, dd-MM-yyyy."""
    head, fmt = {"iso": ("date", "yyyy-MM-dd"), "day_first": ("Date", "dd-MM-yyyy")}[style]
    out = forecast.select(
        F.date_format("day", fmt).alias(head),
        F.col("sku").alias("id_produit"),
        F.bround("pred", 2).alias("quantite_demande"),
        *([F.col("day").alias("day")] if by_day else []),
    )
    writer = out.write.mode("overwrite").option("header", True)
    (writer.partitionBy("day") if by_day else writer).csv(path)


def write_instructions(instructions: DataFrame, path: str) -> None:
    columns = ["Product", "Action", "Location", "Route", "Reason"]
    writer = instructions.select(*columns).write.mode("overwrite").option("header", True)
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
