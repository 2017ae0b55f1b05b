"""Live FIFO ledger: each outgoing event takes the oldest stored event of its (site, product).

Every micro-batch runs the batch ledger over the stock the batch before left, a
written table with one row per stored event. So a busy product spreads over many
tasks, and nothing is kept in task memory. The order is: stored events in the
order they were stored, then the events of the batch by (ts, event_id). An event
that arrives in a later batch than younger ones is thus served after them; its
own time only orders it within its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.functions.labels import direction
from skuflow.operators.ledger import KEYS, current_stock, stock_ledger
from skuflow.operators.prefix import join_on
from skuflow.session import materialize, new_shared_path

OUTCOME = "event_id bigint, site bigint, sku bigint, direction string, ok boolean, in_event bigint"
STORED = "event_id bigint, ts timestamp, site bigint, sku bigint, direction string, seq bigint"


def ledger(events: DataFrame) -> DataFrame:
    """Events of known direction. ``events``: ts, event_id, site, sku, flow_word."""
    known = events.withColumn("direction", direction("flow_word")).where("direction != 'unknown'")
    return known.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "site", "sku", "direction")


def book(batch: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(outcomes of ``batch``, stock after it). ``stored``: the stock before it."""
    rows = batch.withColumns({"seq": F.lit(0).cast("bigint"), "turn": F.lit(1)})
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("turn", F.lit(0)))
    booked = materialize(stock_ledger(rows, order=("turn", "seq", "ts", "event_id")), "live-booked")
    ins = booked.where("direction = 'in'").select(*KEYS, "fifo_no", F.col("event_id").alias("in_event"))
    fresh = booked.where("turn = 1")
    outs = join_on(fresh.where("direction = 'out'"), ins, KEYS, "left", exact=["fifo_no"])
    outcomes = outs.unionByName(fresh.where("direction = 'in'"), allowMissingColumns=True)
    stock = current_stock(booked).withColumn("seq", F.col("fifo_no"))
    return outcomes.select("event_id", *KEYS, "direction", "ok", "in_event"), stock.select("event_id", "ts", *KEYS, "direction", "seq")


def run_to_table(events: DataFrame, label: str = "live-ledger") -> DataFrame:
    """Drain the stream into a table. A replayed micro-batch reads the same stock and replaces its own results."""
    spark = events.sparkSession
    out, stock = new_shared_path(spark, label), new_shared_path(spark, f"{label}-stock")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(STORED).parquet(f"{stock}/{batch_id - 1}") if batch_id else None
        outcomes, after = book(batch, before)
        outcomes.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{stock}/{batch_id}")

    query = (
        events.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", new_shared_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(f"{OUTCOME}, batch int").parquet(out).drop("batch")


def with_sites(events: DataFrame, sites: int = 4) -> DataFrame:
    """Event log rows as flow events: product = user, site by user."""
    from skuflow.sources.tables import flow_word

    return events.select(
        "event_id", "ts", F.col("user_id").alias("sku"), F.pmod("user_id", F.lit(sites)).alias("site"), flow_word().alias("flow_word")
    )
