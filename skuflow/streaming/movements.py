"""Live movements per day and zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.functions.labels import direction
from skuflow.operators.picking import CONGESTED_MOVES
from skuflow.session import new_shared_path


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 100) -> DataFrame:
    """File stream over event files. Times become zoned timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def movements(events: DataFrame, zones: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(window, zone, n) of known-direction events; rows later than the watermark are dropped.

    ``events``: ts, sku, flow_word. ``zones``: sku, zone (a static table).
    """
    known = events.withWatermark("ts", lateness).where(direction("flow_word") != "unknown")
    return known.join(zones, "sku").groupBy(F.window("ts", "1 day"), "zone").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(counts: DataFrame, label: str = "movements") -> DataFrame:
    """Drain the stream and return the latest count per (day, zone), with the alert flag.

    Each micro-batch writes its own folder, so a replayed batch replaces itself.
    Counts only grow, hence the maximum is the latest.
    """
    spark = counts.sparkSession
    out = new_shared_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select(F.to_date("window.start").alias("day"), "zone", "n")
        flat.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", new_shared_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    latest = spark.read.parquet(out).groupBy("day", "zone").agg(F.max("n").alias("n"))
    return latest.withColumn("alert", F.col("n") > CONGESTED_MOVES)
