"""Pick orders: locations, chariot split, tours, totals, congestion.

Orders of usual size are shuffled once by order, and split (up to BLOCK_ITEMS
items) and toured (up to ROW_ITEMS) within their task. An order may be
arbitrarily large, though, and no step gathers the items of a larger one: its
split works on running weights, and its tour is planned over the distinct
positions it visits, which the building bounds, not over its items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions.labels import EXPEDITION, route_text
from skuflow.operators.prefix import join_on, numbered, running, spread
from skuflow.session import materialize

CAPACITY_KG = 300.0
MAX_CHARIOTS = 3
DEFAULT_WEIGHT_KG = 0.5
NAIVE_STEP = 16
BLOCK_ITEMS = 50_000
ROW_ITEMS = 200
CHAINED_CHARIOTS = 8
CONGESTED_PICKS = 3
CONGESTED_MOVES = 5


def manhattan(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.abs(b[0] - a[0]) + F.abs(b[1] - a[1]) + F.abs(b[2] - a[2])


def trips(weight: str = "weight_kg", qty: str = "qty", capacity: float = CAPACITY_KG) -> Column:
    """Chariot trips for a quantity: at least one; a missing or 0 weight counts as 0.5 kg."""
    kg = F.coalesce(F.nullif(F.col(weight), F.lit(0.0)), F.lit(DEFAULT_WEIGHT_KG))
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(kg * F.col(qty) / capacity))


def resolve_slots(items: DataFrame, stored: DataFrame, slots: DataFrame) -> DataFrame:
    """Slot per item: the given one, else the product's first stored slot, else the first PICKING slot.

    A given id of 0 counts as missing. ``stored``: (sku, stored_slot), one row per product.
    """
    first_picking = slots.where("slot_type = 'PICKING'").agg(F.min("slot_id").alias("s")).scalar()
    given = F.nullif(F.col("slot_id"), F.lit(0).cast("bigint"))
    named = ["sku", *[c for c in items.columns if c != "sku"]]
    # only lines without a slot meet the stock
    missing = (
        items.where(given.isNull())
        .join(stored.select("sku", "stored_slot"), "sku", "left")
        .withColumn("_default", first_picking)
        .withColumn("slot_id", F.coalesce("stored_slot", "_default", F.lit(0).cast("bigint")))
    )
    return items.where(given.isNotNull()).withColumn("slot_id", given).select(named).unionByName(missing.select(named))


def locate(items: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their slot's coordinates, items whose slot is unknown)."""
    places = slots.select("slot_id", "code", "x", "y", "z", "zone", "floor", "slot_type")
    joined = items.join(places, "slot_id", "left")
    return joined.where("x IS NOT NULL"), joined.where("x IS NULL").select(items.columns)


def whole_orders(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of orders with at most ``limit`` rows, partitioned by order; rows of larger orders, or None).

    Reads ``rows`` twice, so they are best a written table. A null order is an order of its own.
    """
    sizes = rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if (most or 0) <= limit:
        return spread(rows, ["order_id"], total or 0), None
    large = materialize(sizes.where(F.col("_n") > limit).select("order_id"), "large")
    return spread(join_on(rows, large, ["order_id"], "left_anti"), ["order_id"], total), join_on(rows, large, ["order_id"], "left_semi")


def split_chariots(
    items: DataFrame, order: tuple[str, ...], capacity_kg: float = CAPACITY_KG, max_chariots: int = MAX_CHARIOTS
) -> DataFrame:
    """Add item_no and chariot: items fill chariots in order; the last chariot takes the rest.

    A chariot ends before the first item that would overload it, unless it is
    still empty. So each chariot's end is the first item, after its own first
    item, where the running weight since its start exceeds the capacity. Weights
    are whole grams, so running sums are exact. Orders of usual size are split
    by windows over one sort, one more window per chariot; larger ones, and more
    than CHAINED_CHARIOTS chariots, by written boundaries.
    """
    grams = F.round(F.coalesce("weight_kg", F.lit(DEFAULT_WEIGHT_KG)) * F.col("qty") * 1000).cast("bigint")
    weighed = items.withColumn("grams", grams)
    if max_chariots > CHAINED_CHARIOTS:
        return _split_by_boundaries(weighed, order, capacity_kg, max_chariots)
    usual, large = whole_orders(materialize(weighed, "items"), BLOCK_ITEMS)
    split = _split_by_windows(usual, order, capacity_kg, max_chariots)
    return split if large is None else split.unionByName(_split_by_boundaries(large, order, capacity_kg, max_chariots))


def _split_by_windows(items: DataFrame, order: tuple[str, ...], capacity_kg: float, max_chariots: int) -> DataFrame:
    """Split of ``items`` (with grams) where an order fits into a task."""
    along = Window.partitionBy("order_id").orderBy(*order)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = {"item_no": F.row_number().over(along).cast("bigint"), "_cum": F.sum("grams").over(along.rowsBetween(Window.unboundedPreceding, 0))}
    run = items.withColumns(numbers)
    chariot, first, base = F.lit(1).cast("bigint"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for n in range(1, max_chariots):
        over = (F.col("item_no") > first) & (F.col("_cum") - base > round(capacity_kg * 1000))
        passing = F.struct("item_no", (F.col("_cum") - F.col("grams")).alias("base"))
        run = run.withColumn(f"_end{n}", F.min(F.when(over, passing)).over(whole))
        first, base = F.col(f"_end{n}.item_no"), F.col(f"_end{n}.base")
        chariot = chariot + F.coalesce((F.col("item_no") >= first).cast("bigint"), F.lit(0))
    return run.select(*items.columns, "item_no", chariot.alias("chariot"))


def _split_by_boundaries(items: DataFrame, order: tuple[str, ...], capacity_kg: float, max_chariots: int) -> DataFrame:
    """Split of ``items`` (with grams) without gathering an order.

    The running weights are written once; every boundary is one small written table,
    found from the one before, so the plan does not grow with the chariots.
    Boundaries meet items per block of items, so that a huge order is not one
    join key.
    """
    run = running(items, ["order_id"], order, {"item_no": F.lit(1).cast("bigint"), "_cum": F.col("grams")})
    run = materialize(run.withColumn("_block", F.floor(F.col("item_no") / BLOCK_ITEMS)), "weights")
    limit = round(capacity_kg * 1000)
    one = F.lit(1).cast("bigint")
    passing = F.struct("item_no", (F.col("_cum") - F.col("grams")).alias("base"))
    found: list[DataFrame] = []
    for n in range(1, max_chariots):
        if n == 1:  # every order's first chariot starts at its first item, so nothing has to be met
            over = (F.col("item_no") > 1) & (F.col("_cum") > limit)
            ends = run.groupBy("order_id").agg(F.min(F.when(over, passing)).alias("e"), F.max("_block").alias("_last")).where("e IS NOT NULL")
        else:
            met = join_on(run.select("order_id", "item_no", "grams", "_cum", "_block"), _per_block(starts, "_first"), ["order_id"], exact=["_block"])
            over = met.where((F.col("item_no") > F.col("_first")) & (F.col("_cum") - F.col("_base") > limit))
            ends = over.groupBy("order_id").agg(F.min(passing).alias("e"), F.max("_last").alias("_last"))
        starts = materialize(
            ends.select("order_id", F.col("e.item_no").alias("_first"), F.col("e.base").alias("_base"), "_last"), "ends"
        )
        found.append(starts)
    if not found:
        return run.withColumn("chariot", one).drop("_cum", "_block")
    bounds = reduce(DataFrame.unionByName, found).groupBy("order_id").agg(F.min("_first").alias("_from"), F.collect_list("_first").alias("_ends"), F.max("_last").alias("_last"))
    split = join_on(run, _per_block(bounds, "_from"), ["order_id"], "left", exact=["_block"])
    passed = F.size(F.filter(F.coalesce("_ends", F.array().cast("array<bigint>")), lambda e: e <= F.col("item_no")))
    return split.withColumn("chariot", one + passed).select(*[c for c in run.columns if c not in ("_cum", "_block")], "chariot")


def _per_block(bounds: DataFrame, first: str) -> DataFrame:
    """Repeat a row for all blocks from that of ``first`` to the order's last."""
    return bounds.withColumn("_block", F.explode(F.sequence(F.floor(F.col(first) / BLOCK_ITEMS), "_last")))


_LEG = "abs(p.x - s.x) + abs(p.y - s.y) + abs(p.z - s.z)"
_STOP = "first_no: bigint, x: bigint, y: bigint, z: bigint, n: bigint, skus: bigint"
_VISIT = "seq: bigint, x: bigint, y: bigint, z: bigint, dist: bigint, before: bigint, from_level: bigint"
_ITEM = "item_no: bigint, x: bigint, y: bigint, z: bigint, sku: bigint, code: string, zone: string, grams: bigint"


def _nearest_neighbour(number: str, size: str, carried: dict[str, str]) -> Column:
    """Fold over the array ``stops`` of one chariot: always the nearest next, the least ``number`` on a tie.

    ``size`` is how many items a stop takes; ``carried`` names more fields, with their types, that a visit keeps.
    """
    kept = "".join(f", p.{c}" for c in carried)
    types = "".join(f", {c}: {t}" for c, t in carried.items())
    start = (
        f"named_struct('x', {EXPEDITION[0]}L, 'y', {EXPEDITION[1]}L, 'z', {EXPEDITION[2]}L, 'done', 0L, "
        f"'left', stops, 'tour', cast(array() AS array<struct<{_VISIT}{types}>>))"
    )
    nearest = f"array_min(transform(s.left, p -> struct({_LEG} AS dist, p.{number} AS no, p.x, p.y, p.z, {size} AS n{kept})))"
    visit = (
        "named_struct('seq', k, 'x', m.x, 'y', m.y, 'z', m.z, 'dist', m.dist, 'before', s.done, 'from_level', s.z"
        + "".join(f", '{c}', m.{c}" for c in carried)
        + ")"
    )
    step = (
        f"transform(array({nearest}), m -> named_struct('x', m.x, 'y', m.y, 'z', m.z, 'done', s.done + m.n, "
        f"'left', filter(s.left, p -> p.{number} != m.no), 'tour', array_append(s.tour, {visit})))[0]"
    )
    return F.expr(f"aggregate(sequence(1L, cast(size(stops) AS bigint)), {start}, (s, k) -> {step}, s -> s.tour)")


def _tours(located: DataFrame) -> DataFrame:
    positions = located.groupBy("order_id", "chariot", "x", "y", "z").agg(
        F.min("item_no").alias("first_no"), F.count(F.lit(1)).alias("n"), F.count("sku").alias("skus")
    )
    stops = F.collect_list(F.struct("first_no", "x", "y", "z", "n", "skus")).cast(f"array<struct<{_STOP}>>")
    return (
        positions.groupBy("order_id", "chariot")
        .agg(stops.alias("stops"))
        .select("order_id", "chariot", _nearest_neighbour("first_no", "p.n", {"skus": "bigint"}).alias("tour"))
    )


def chariot_tours(located: DataFrame) -> DataFrame:
    """(order_id, chariot, tour): one row per chariot with its positions in visiting order.

    All items at one position are 0 apart and are taken together, so the greedy
    tour over items equals the greedy tour over positions.
    """
    usual, large = whole_orders(located, BLOCK_ITEMS)
    return _tours(usual) if large is None else _tours(usual).unionByName(_tours(large))


def tour_stops(located: DataFrame) -> DataFrame:
    """(order_id, chariot, seq, x, y, z, dist, before, from_level, skus): positions in visiting order; skus counts the
    items with a product that are taken there."""
    return chariot_tours(located).select("order_id", "chariot", F.inline("tour"))


def pick_tours(located: DataFrame) -> DataFrame:
    """One row per pick, plus one return row per chariot, with step number and distance."""
    usual, large = whole_orders(located, ROW_ITEMS)
    steps = _steps_in_rows(usual)
    return steps if large is None else steps.unionByName(_steps_by_position(large))


def _steps_in_rows(located: DataFrame) -> DataFrame:
    """Steps where a chariot's items fit into a row, which is folded item by item."""
    items = F.array_sort(F.collect_list(F.struct("item_no", "x", "y", "z", "sku", "code", "zone", "grams"))).cast(f"array<struct<{_ITEM}>>")
    # items are told apart by their place, as a slot listed twice gives an item number twice
    placed = F.transform(items, lambda p, i: p.withField("place", i))
    carried = {"sku": "bigint", "code": "string", "zone": "string", "grams": "bigint"}
    tours = (
        located.groupBy("order_id", "chariot")
        .agg(placed.alias("stops"))
        .select("order_id", "chariot", _nearest_neighbour("place", "1L", carried).alias("tour"))
    )

    def pick(v: Column) -> Column:
        return F.struct(
            v["seq"].alias("step"),
            F.lit("pick").alias("action"),
            v["sku"].alias("sku"),
            v["code"].alias("code"),
            v["zone"].alias("zone"),
            v["z"].alias("level"),
            v["from_level"].alias("from_level"),
            v["dist"].cast("double").alias("distance"),
            (v["grams"] / 1000).alias("kg"),
        )

    home = tuple(F.lit(v) for v in EXPEDITION)
    last = F.element_at("tour", -1)
    back = F.struct(
        (last["seq"] + 1).alias("step"),
        F.lit("return").alias("action"),
        F.lit(None).cast("bigint").alias("sku"),
        F.lit("EXPEDITION").alias("code"),
        F.lit("B7-N0").alias("zone"),
        F.lit(0).cast("bigint").alias("level"),
        last["z"].alias("from_level"),
        manhattan((last["x"], last["y"], last["z"]), home).cast("double").alias("distance"),
        F.lit(None).cast("double").alias("kg"),
    )
    return tours.select("order_id", "chariot", F.inline(F.concat(F.transform("tour", pick), F.array(back))))


def _steps_by_position(located: DataFrame) -> DataFrame:
    """Steps where a chariot may be of any size: its items are numbered and meet the stops of its tour."""
    stops = _tours(located).select("order_id", "chariot", F.inline("tour"))
    at = ["order_id", "chariot", "x", "y", "z"]
    in_place = numbered(located, at, ["item_no"], "_at")
    picks = join_on(in_place, stops, at).select(
        "order_id",
        "chariot",
        (F.col("before") + F.col("_at")).alias("step"),
        F.lit("pick").alias("action"),
        "sku",
        "code",
        "zone",
        F.col("z").alias("level"),
        F.when(F.col("_at") == 1, F.col("from_level")).otherwise(F.col("z")).alias("from_level"),
        F.when(F.col("_at") == 1, F.col("dist")).otherwise(F.lit(0)).cast("double").alias("distance"),
        (F.col("grams") / 1000).alias("kg"),
    )
    home = tuple(F.lit(v) for v in EXPEDITION)
    ends = stops.groupBy("order_id", "chariot").agg(F.max_by(F.struct("x", "y", "z"), "seq").alias("last"))
    counts = located.groupBy("order_id", "chariot").agg(F.count(F.lit(1)).alias("n"))
    back = join_on(ends, counts, ["order_id", "chariot"]).select(
        "order_id",
        "chariot",
        (F.col("n") + 1).alias("step"),
        F.lit("return").alias("action"),
        F.lit(None).cast("bigint").alias("sku"),
        F.lit("EXPEDITION").alias("code"),
        F.lit("B7-N0").alias("zone"),
        F.lit(0).cast("bigint").alias("level"),
        F.col("last.z").alias("from_level"),
        manhattan((F.col("last.x"), F.col("last.y"), F.col("last.z")), home).cast("double").alias("distance"),
        F.lit(None).cast("double").alias("kg"),
    )
    return picks.unionByName(back)


def chariot_totals(steps: DataFrame) -> DataFrame:
    """Items, distance and weight (one digit) per chariot."""
    return steps.groupBy("order_id", "chariot").agg(
        F.count("sku").alias("items"),
        F.sum("distance").alias("distance"),
        F.bround(F.sum("kg"), 1).alias("weight_kg"),
    )


def tour_totals(steps: DataFrame) -> DataFrame:
    """Per order: chariots, items, distance, gain over 16 units per item."""
    naive = F.count("sku") * NAIVE_STEP
    return steps.groupBy("order_id").agg(
        F.max("chariot").alias("chariots"),
        F.count("sku").alias("items"),
        F.sum("distance").alias("distance"),
        ((naive - F.sum("distance")) / naive * 100).alias("efficiency_pct"),
    )


def order_totals(located: DataFrame) -> DataFrame:
    """What ``tour_totals`` gives for the tours over ``located``, without numbering their steps.

    The distance is that between the positions, and the way home.
    """
    home = tuple(F.lit(v) for v in EXPEDITION)
    last = F.element_at("tour", -1)
    added = lambda field: F.aggregate("tour", F.lit(0).cast("bigint"), lambda total, v: total + v[field])
    ways = (
        chariot_tours(located)
        .select("order_id", "chariot", added("skus").alias("n"), (added("dist") + manhattan((last["x"], last["y"], last["z"]), home)).alias("way"))
        .groupBy("order_id")
        .agg(F.max("chariot").alias("chariots"), F.sum("n").alias("items"), F.sum(F.col("way").cast("double")).alias("distance"))
    )
    naive = F.col("items") * NAIVE_STEP
    return ways.select(
        "order_id", "chariots", "items", "distance", ((naive - F.col("distance")) / naive * 100).alias("efficiency_pct")
    )


def zone_congestion(steps: DataFrame) -> DataFrame:
    """Zones and levels an order visits more than three times."""
    return (
        steps.where("action = 'pick'")
        .groupBy("order_id", "zone", "level")
        .agg(F.count(F.lit(1)).alias("picks"))
        .where(F.col("picks") > CONGESTED_PICKS)
    )


def daily_congestion(moves: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """One row per movement beyond the fifth in a zone on a day."""
    counted = numbered(moves, ["day", "zone"], order, "n_moves")
    return counted.where(F.col("n_moves") > CONGESTED_MOVES)


def nested_tours(stops: DataFrame) -> DataFrame:
    """One row per chariot with its stops as an array, bounded by the positions of the building."""
    route = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z", "dist")))
    return stops.groupBy("order_id", "chariot").agg(route.alias("stops"), F.sum("dist").alias("distance_out"))


def step_details(steps: DataFrame, slots: DataFrame) -> DataFrame:
    """Route text of each step, from the level of the stop before."""
    places = slots.select("code", "floor", "slot_type")
    out = steps.join(places, "code", "left").withColumn("z", F.col("level"))
    detail = F.when(F.col("action") == "return", F.lit("Retour zone expedition")).otherwise(
        route_text(F.col("from_level"))
    )
    return out.withColumn("detail", detail).drop("z", "floor", "slot_type")
