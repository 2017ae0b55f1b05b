"""Outcome of every flow event of a batch: slot, route, trips, reason, success."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.functions import labels as L
from skuflow.operators import ledger as K
from skuflow.operators import picking as P
from skuflow.operators import slots as W
from skuflow.operators.prefix import join_on
from skuflow.session import materialize

SLOT_COLUMNS = ["slot_id", "code", "x", "y", "z", "zone", "floor", "slot_type", "dist"]
PRODUCT_COLUMNS = ["segment", "demand_freq", "weight_kg"]


def with_product_class(events: DataFrame, product_class: DataFrame) -> DataFrame:
    """Add segment, frequency and weight; unknown products are LF, frequency 0, weight 0."""
    joined = events.join(product_class.select("sku", *PRODUCT_COLUMNS), "sku", "left")
    return joined.fillna("LF", ["segment"]).fillna(0.0, ["demand_freq", "weight_kg"])


def slot_events(events: DataFrame, slots: DataFrame, batch: str = "day") -> DataFrame:
    """Events with direction, ok and the slot concerned, every batch on its own.

    Each batch starts with the given free slots. Ingoing events are placed first
    (see ``slots.assign``); those that found a slot feed the ledger of their
    product, and each successful outgoing event takes the slot of the ingoing
    event it releases. See ``carried_events`` for batches that follow each other.
    """
    keys = [batch, "site", "sku"]
    return _released(_booked(events, slots, batch, keys), keys)


def _booked(events: DataFrame, slots: DataFrame, batch: str, keys: Sequence[str], held: DataFrame | None = None) -> DataFrame:
    """Ledger of the placed and other events, behind the goods already ``held``."""
    tagged = W.target_type(events.withColumn("direction", L.direction("flow_word")))
    placed = W.assign(tagged.where("direction = 'in'"), slots, batch=[batch])
    everything = placed.unionByName(tagged.where("direction != 'in'"), allowMissingColumns=True)
    if held is not None:
        everything = everything.unionByName(held, allowMissingColumns=True)
    unplaced = (F.col("direction") == "in") & F.col("slot_id").isNull()
    counted = everything.withColumns(
        {"_way": F.col("direction"), "direction": F.when(unplaced, "unplaced").otherwise(F.col("direction"))}
    )
    return K.stock_ledger(counted, keys)


def _released(booked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give each successful outgoing event the slot of the ingoing event it releases."""
    sources = booked.where("direction = 'in'").select(*keys, "fifo_no", F.struct(*SLOT_COLUMNS).alias("_from"))
    outs = join_on(booked.where("direction = 'out'"), sources, keys, "left", exact=["fifo_no"])
    outs = outs.withColumns({c: F.col(f"_from.{c}") for c in SLOT_COLUMNS}).drop("_from")
    return (
        booked.where("direction != 'out'")
        .unionByName(outs)
        .withColumn("direction", F.col("_way"))
        .drop("_way", "fifo_no", "held", "target_type")
    )


def carried_events(events: DataFrame, slots: DataFrame, batch: str = "day") -> tuple[DataFrame, DataFrame]:
    """As ``slot_events``, but each batch starts from the slots and goods the batch before left.

    Batches run in order (null first), one after the other, since a slot is free only once it was released; what goes
    from one to the next is a written table with one row per occupied slot. Returns the events, and (batch, slot_id) of
    the slots occupied at the end of each batch. The driver sees the list of batches only.
    """
    keys = ["site", "sku"]
    rows: list[DataFrame] = []
    left: list[DataFrame] = []
    held: DataFrame | None = None
    for (value,) in events.select(batch).distinct().orderBy(F.asc_nulls_first(batch)).collect():
        own = events.where(F.col(batch).eqNullSafe(F.lit(value)))
        free = slots if held is None else W.free_slots(slots, held)
        booked = materialize(_booked(own, free, batch, keys, held), "booked")
        stock = K.current_stock(booked, keys).where("slot_id IS NOT NULL").drop("fifo_no", "held", "ok", "_way")
        held = materialize(stock.withColumn("_carried", F.lit(True)), "held")
        done = _released(booked, keys)
        rows.append(done.where("_carried IS NULL").drop("_carried") if "_carried" in done.columns else done)
        left.append(held.select(F.lit(value).cast(events.schema[batch].dataType).alias(batch), "slot_id"))
    if not rows:
        empty = slot_events(events, slots, batch)
        return empty, empty.select(batch, "slot_id").limit(0)
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union(rows), union(left)


def outcomes(booked: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Texts, trips and flags of the service answer. ``forecast``: (sku, day, forecast_demand), or without day."""
    way, ok = F.col("direction"), F.col("ok")

    def pick(in_ok, in_failed, out_ok, out_failed, unknown):
        return (
            F.when((way == "in") & ok, in_ok)
            .when((way == "in"), in_failed)
            .when((way == "out") & ok, out_ok)
            .when((way == "out"), out_failed)
            .otherwise(unknown)
        )

    # an unplaced ingoing event has no slot and is not ok
    rows = booked.withColumn("ok", F.coalesce(F.col("slot_id").isNotNull(), F.lit(False)))
    if forecast is not None:
        rows = rows.join(forecast, [c for c in ("sku", "day") if c in forecast.columns], "left")
    else:
        rows = rows.withColumn("forecast_demand", F.lit(None).cast("double"))
    null = F.lit(None).cast("string")
    none = F.lit("")
    return rows.select(
        "event_id",
        "day",
        "sku",
        "site",
        "direction",
        "qty",
        pick(
            F.concat(F.lit("Reception -> Stockage en "), F.col("code")),
            F.lit(L.NO_SLOT_ACTION),
            F.concat(F.lit("Picking depuis "), F.col("code"), F.lit(" -> Expedition")),
            F.lit(L.STOCK_OUT_ACTION),
            F.lit(L.UNKNOWN_ACTION),
        ).alias("action"),
        "slot_id",
        "code",
        "zone",
        pick(L.receipt_route(), null, L.expedition_route(), null, null).alias("route"),
        F.when(ok, P.trips()).alias("trips"),
        pick(L.storage_reason(), F.lit(L.NO_SLOT_REASON), L.picking_reason(), L.stock_out_reason(), null).alias("reason"),
        F.when(way != "unknown", F.col("forecast_demand")).alias("forecast_demand"),
        F.col("ok").alias("success"),
        pick(
            none, F.lit(L.NO_SLOT_WARNING), none, F.lit(L.STOCK_OUT_WARNING), L.unknown_warning("flow_word")
        ).alias("warning"),
    )


def instructions(booked: DataFrame) -> DataFrame:
    """Product, Action, Location, Route, Reason per event, the instruction-file form."""
    way, has_slot = F.col("direction"), F.col("slot_id").isNotNull()
    na = F.lit("N/A")
    reason = (
        F.when((way == "in") & has_slot, L.storage_reason_short())
        .when(way == "in", F.lit("No available slots"))
        .when((way == "out") & has_slot, L.picking_reason_short())
        .when(way == "out", F.format_string("Product %d not in stock - stockout", "sku"))
        .otherwise(F.concat(F.lit("Unknown flow type: "), F.lower(F.trim("flow_word"))))
    )
    return booked.select(
        "event_id",
        "day",
        F.col("sku").alias("Product"),
        F.when(way == "in", "Storage").when(way == "out", "Picking").otherwise("Unknown").alias("Action"),
        F.coalesce("code", na).alias("Location"),
        F.when(has_slot, L.instruction_route("direction")).otherwise(na).alias("Route"),
        reason.alias("Reason"),
    )


def instruction_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("Action") == "Storage").alias("storages"),
        F.count_if(F.col("Action") == "Picking").alias("pickings"),
        F.count_if(F.contains(F.col("Location"), F.lit("N/A"))).alias("failures"),
    )


def congestion_warnings(booked: DataFrame) -> DataFrame:
    """One text per outgoing movement beyond the fifth in a zone on a day."""
    moves = booked.where("direction = 'out' AND slot_id IS NOT NULL")
    return P.daily_congestion(moves).select(
        "event_id",
        "day",
        "zone",
        "n_moves",
        F.format_string(
            "%s: Zone %s - %d mouvements, congestion possible", F.col("day").cast("string"), "zone", "n_moves"
        ).alias("warning"),
    )


def end_of_batch_slots(booked: DataFrame, batch: str = "day") -> DataFrame:
    """(batch, slot_id) still occupied when a batch ends."""
    placed = booked.where("direction = 'in' AND slot_id IS NOT NULL").select(batch, "slot_id")
    released = booked.where("direction = 'out' AND slot_id IS NOT NULL").select(batch, "slot_id")
    return join_on(placed, released, [batch], "left_anti", exact=["slot_id"])
