"""Slot ledger: which outgoing events find stock, and which slot they release.

Every ingoing event of a product adds one slot, every outgoing event releases
the oldest one; an outgoing event on an empty ledger is a stock-out and changes
nothing. That is a running sum reflected at zero: with net = running sum of
+1/-1 and low = its minimum before the row, an outgoing event succeeds exactly
when net >= min(0, low), and held = net - min(0, low, net). Running sums and
minima combine over slices, so a product with a third of all events still
spreads over many tasks. Events with a null key form a ledger of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.operators.prefix import join_on, running

KEYS = ("site", "sku")
ORDER = ("ts", "event_id")


def stock_ledger(events: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Add ok, held and fifo_no to events with a ``direction`` of in, out or anything else (ignored).

    fifo_no numbers the ingoing events and, separately, the successful outgoing
    events of a key; equal numbers belong together.
    """
    way = F.col("direction")
    step = F.when(way == "in", 1).when(way == "out", -1).otherwise(0).cast("long")
    arrived = (way == "in").cast("long")
    run = running(events, keys, order, {"net": step, "ins": arrived}, {"low": "net"})
    floor = F.least(F.coalesce("low", F.lit(0)), F.lit(0))
    out = run.withColumns(
        {
            "ok": F.when(way == "out", F.col("net") >= floor).otherwise(way == "in"),
            "held": F.col("net") - F.least(floor, F.col("net")),
        }
    )
    number = F.when(way == "in", F.col("ins")).when((way == "out") & F.col("ok"), F.col("ins") - F.col("held"))
    return out.withColumn("fifo_no", number).drop("net", "ins", "low")


def fifo_match(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., fifo_no, in_event, out_event): the ingoing event each outgoing one releases."""
    ins = ledger.where("direction = 'in'").select(*keys, "fifo_no", F.col("event_id").alias("in_event"))
    outs = ledger.where("direction = 'out' AND ok").select(*keys, "fifo_no", F.col("event_id").alias("out_event"))
    return join_on(outs, ins, keys, exact=["fifo_no"])


def current_stock(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ingoing events whose slot is still held."""
    released = ledger.where("direction = 'out' AND ok").select(*keys, "fifo_no")
    return join_on(ledger.where("direction = 'in'"), released, keys, "left_anti", exact=["fifo_no"])


def oldest_stock(stock: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First stored event per key: the one the next outgoing event takes."""
    return stock.groupBy(*keys).agg(F.min("fifo_no").alias("fifo_no"), F.min_by("event_id", "fifo_no").alias("event_id"))


def site_load(ledger: DataFrame, slots: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Slots in use at the site after each event, and whether the site would be over-full."""
    change = F.when(F.col("ok"), F.when(F.col("direction") == "in", 1).otherwise(-1)).otherwise(0).cast("long")
    run = running(ledger, ["site"], order, {"site_held": change})
    capacity = slots.groupBy("site").agg(F.count("slot_id").alias("site_slots"))
    # one row per site
    return join_on(run, F.broadcast(capacity), ["site"], "left").withColumn("over_full", F.col("site_held") > F.coalesce("site_slots", F.lit(0)))
