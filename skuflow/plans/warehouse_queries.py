"""Registered queries on the warehouse: ledger, slots, outcomes, picking.

A day's events form one batch. In the ``carried_`` queries each day starts from
the slots the day before left; in the other day queries it is planned against
the empty warehouse, like one simulation request with reset. The plain ledger
queries run over the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.functions import labels as L
from skuflow.functions.clean import rounded, whole_number_or
from skuflow.operators import auction as A
from skuflow.operators import demand as D
from skuflow.operators import ledger as K
from skuflow.operators import outcomes as O
from skuflow.operators import picking as P
from skuflow.operators import slots as W
from skuflow.operators.prefix import spread
from skuflow.plans.demand_queries import by_part
from skuflow.session import materialize, new_shared_path
from skuflow.sources import tables as S
from skuflow.streaming import warehouse as live_warehouse


def _events(spark, sf) -> DataFrame:
    return S.flow_events(spark, sf).withColumn("direction", L.direction("flow_word"))


def flow_canonical(spark, sf):
    return _events(spark, sf).select("event_id", "flow_word", "direction")


def flow_counts(spark, sf):
    return D.value_counts(_events(spark, sf), "direction")


def coerced_events(spark, sf):
    """Whole-number reading of a text field, bad values as -1, over all events."""
    raw = S.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return raw.select(
        "event_id", whole_number_or("k", -1).alias("k"), whole_number_or("event_type", -1).alias("type_no")
    )


def slot_counts(spark, sf):
    slots = S.slots(spark, sf, "customer")
    parts = [
        D.value_counts(slots.select(F.col(c).cast("string").alias("value")), "value").withColumn("field", F.lit(c))
        for c in ("slot_type", "zone", "z")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ledger(spark, sf) -> DataFrame:
    return K.stock_ledger(_events(spark, sf))


def stock_ledger(spark, sf):
    return _ledger(spark, sf).select("event_id", "site", "sku", "direction", "ok", "held", "fifo_no")


def fifo_match(spark, sf):
    return K.fifo_match(materialize(_ledger(spark, sf), "ledger"))


def current_stock(spark, sf):
    stock = K.current_stock(materialize(_ledger(spark, sf), "ledger"))
    return stock.groupBy("site", "sku").agg(
        F.count("event_id").alias("slots_held"), F.min("fifo_no").alias("oldest_no"), F.sum("qty").alias("qty")
    ).withColumn("qty", rounded("qty", 2))


def site_load(spark, sf):
    load = K.site_load(_ledger(spark, sf), S.slots(spark, sf))
    return load.select("event_id", "site", "site_held", "site_slots", "over_full")


def _stock_plan(spark, sf) -> DataFrame:
    """Slots for everything on hand at the end of the history, as one batch over the customer-keyed slots."""
    stock = K.current_stock(materialize(_ledger(spark, sf), "ledger"))
    classed = O.with_product_class(stock, _product_class(spark, sf)).drop("fifo_no", "held", "ok")
    arrivals = W.target_type(classed.withColumn("batch", F.lit(1)))
    return W.assign(arrivals, S.slots(spark, sf, "customer"), batch=["batch"])


def occupancy(spark, sf):
    plan = _stock_plan(spark, sf).where("slot_id IS NOT NULL")
    return W.occupancy(S.slots(spark, sf, "customer"), plan)


def free_slots(spark, sf):
    plan = _stock_plan(spark, sf).where("slot_id IS NOT NULL")
    return W.free_slots(S.slots(spark, sf, "customer"), plan, "PICKING").select("slot_id", "site", "code", "dist")


def _product_class(spark, sf) -> DataFrame:
    """Segment, demand frequency and weight per product."""
    d = by_part(spark, sf).shared()
    freq = D.demand_frequency(d.daily.withColumn("_n", D.n_days(d.start, d.end)), F.max("_n"))
    return (
        D.segments(d.daily)
        .select("sku", "segment")
        .join(freq, "sku")
        .join(S.products(spark, sf).select("sku", "weight_kg"), "sku", "left")
    )


def slot_scores_topk(spark, sf):
    """Best five slots per site, type and product class."""
    best = W.best_slots(W.clean_slots(S.slots(spark, sf, "customer")), 5)
    return best.select("site", "slot_type", "segment", "heavy", "pos", "slot_id", "score")


def slot_labels(spark, sf):
    """Zone label and routes of every slot."""
    return S.slots(spark, sf, "customer").select(
        "slot_id",
        L.zone_label().alias("label"),
        L.receipt_route().alias("receipt"),
        L.expedition_route().alias("expedition"),
        L.instruction_route(F.lit("in")).alias("short_in"),
        L.instruction_route(F.lit("out")).alias("short_out"),
    )


def slot_assignment(spark, sf):
    events = O.with_product_class(_events(spark, sf).where("direction = 'in'"), _product_class(spark, sf))
    plan = W.assign(W.target_type(events), S.slots(spark, sf))
    return plan.select("event_id", "day", "site", "target_type", "slot_id", F.when(F.col("slot_id").isNotNull(), F.col("slot_type")).alias("slot_type"))


def slot_auction(spark, sf):
    """Arrivals of a day against the free slots of their site: type, segment and weight decide together."""
    events = O.with_product_class(_events(spark, sf).where("direction = 'in'"), _product_class(spark, sf))
    plan = A.assign_by_auction(W.target_type(events), S.slots(spark, sf))
    return plan.select("event_id", "day", "site", "target_type", "segment", "heavy", "slot_id", "slot_type", "score")


def _booked(spark, sf) -> DataFrame:
    events = O.with_product_class(S.flow_events(spark, sf), _product_class(spark, sf))
    return O.slot_events(events, S.slots(spark, sf))


def event_outcomes(spark, sf):
    average = by_part(spark, sf).daily.groupBy("sku").agg(F.avg("demand").alias("a"))
    return O.outcomes(_booked(spark, sf), average.select("sku", rounded("a", 2).alias("forecast_demand")))


def instructions(spark, sf):
    return O.instructions(_booked(spark, sf))


def instruction_summary(spark, sf):
    return O.instruction_summary(O.instructions(_booked(spark, sf)))


def congestion_log(spark, sf):
    return O.congestion_warnings(_booked(spark, sf))


def daily_congestion(spark, sf):
    """Movements beyond the fifth of a day and zone; the zone is that of the product's home slot."""
    events = _events(spark, sf).where("direction != 'unknown'")
    home = S.slots(spark, sf, "customer").select(F.col("slot_id").alias("sku"), "zone")
    moves = events.join(home, "sku")
    return P.daily_congestion(moves).select("event_id", "day", "zone", "n_moves")


def daily_occupancy(spark, sf):
    booked = materialize(_booked(spark, sf), "booked")
    return W.batch_occupancy(S.slots(spark, sf), O.end_of_batch_slots(booked))


def carried_outcomes(spark, sf):
    """Every event of the history when each day starts from the slots the day before left, by a keyed state per site."""
    folder = new_shared_path(spark, "flow")
    events = S.flow_events(spark, sf)
    events.write.parquet(folder)
    last = events.agg(F.max("ts")).first()[0]
    if last is not None:
        live_warehouse.closing_rows(events, last, folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    typed = W.target_type(O.with_product_class(stream, _product_class(spark, sf)))
    rows, _ = live_warehouse.run_to_table(live_warehouse.carried(typed, S.slots(spark, sf)))
    return rows.select("event_id", "day", "sku", "site", "direction", "slot_id", "success")


# ------------------------------------------------------------------- picking

ITEM_ORDER = ("line_no", "sku", "slot_id")


def _items(spark, sf) -> DataFrame:
    """Pick lines with their slots resolved: the given one, the first stored one, the first PICKING slot."""
    stock = K.oldest_stock(K.current_stock(materialize(_ledger(spark, sf), "ledger")), ["sku"])
    stored = stock.select("sku", (F.col("event_id") % 50).alias("stored_slot"))
    return P.resolve_slots(S.pick_lines(spark, sf), stored, S.slots(spark, sf))


def location_fallback(spark, sf):
    """Slot per pick line: a given slot, else the product's first stored slot, else the first PICKING slot."""
    items = materialize(_items(spark, sf), "items")
    located, unknown = P.locate(items, S.slots(spark, sf))
    both = located.select("order_id", "line_no", "sku", "slot_id", F.lit(True).alias("known")).unionByName(
        unknown.select("order_id", "line_no", "sku", "slot_id", F.lit(False).alias("known"))
    )
    keys = ["sku", "slot_id", "known"]
    return spread(both.select(keys), keys, items.count()).groupBy(keys).agg(F.count(F.lit(1)).alias("n"))


def _split(spark, sf) -> DataFrame:
    return P.split_chariots(_items(spark, sf), ITEM_ORDER)


def chariot_split(spark, sf):
    return _split(spark, sf).select("order_id", "item_no", "sku", "slot_id", "grams", "chariot")


def _located(spark, sf) -> DataFrame:
    located, _ = P.locate(_split(spark, sf), S.slots(spark, sf))
    return materialize(located, "located")


def _steps(spark, sf) -> DataFrame:
    return P.pick_tours(_located(spark, sf))


def pick_tours(spark, sf):
    steps = P.step_details(_steps(spark, sf), S.slots(spark, sf))
    return steps.select("order_id", "chariot", "step", "action", "sku", "code", "distance", "detail")


def chariot_totals(spark, sf):
    return P.chariot_totals(_steps(spark, sf))


def tour_totals(spark, sf):
    return P.order_totals(_located(spark, sf)).withColumn("efficiency_pct", rounded("efficiency_pct"))


def zone_congestion(spark, sf):
    return P.zone_congestion(_steps(spark, sf))


def nested_tours(spark, sf):
    """Stops of every chariot as one array."""
    tours = P.nested_tours(P.tour_stops(_located(spark, sf)))
    path = F.transform("stops", lambda s: F.concat_ws(",", s["x"], s["y"], s["z"]))
    return tours.select("order_id", "chariot", F.array_join(path, " ").alias("path"), F.col("distance_out"))


def chariot_trips(spark, sf):
    """Trips each order line needs."""
    return S.pick_lines(spark, sf).groupBy(P.trips().alias("trips")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        flow_canonical, flow_counts, coerced_events, slot_counts, stock_ledger, fifo_match, current_stock, site_load,
        occupancy, free_slots, slot_scores_topk, slot_labels, slot_assignment, slot_auction, event_outcomes, instructions,
        instruction_summary, congestion_log, daily_congestion, daily_occupancy, carried_outcomes, location_fallback, chariot_split,
        pick_tours, chariot_totals, tour_totals, zone_congestion, nested_tours, chariot_trips,
    )
}
