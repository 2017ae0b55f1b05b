"""Slot scoring, batch slot assignment, free slots, occupancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.operators.prefix import join_on, numbered

# Weight of distance and of level per class, extra level weight for heavy goods.
WEIGHTS = {"HF": (3.0, 5.0), "LF": (1.0, 2.0)}
HEAVY_KG, HEAVY_LEVEL_WEIGHT = 5.0, 10.0
MISSING_DISTANCE, MISSING_LEVEL = 8.0, 0
PICKING_MIN_FREQUENCY = 0.01


def clean_slots(slots: DataFrame) -> DataFrame:
    """Distances and levels that do not parse become 8 and 0."""
    return slots.withColumns(
        {
            "dist": F.coalesce(F.col("dist").try_cast("double"), F.lit(MISSING_DISTANCE)),
            "z": F.coalesce(F.col("z").try_cast("bigint"), F.lit(MISSING_LEVEL).cast("bigint")),
        }
    )


def slot_score(hf: Column, heavy: Column) -> Column:
    """Higher is better: near the expedition zone, low level, heavy goods on the floor."""
    dist, z = F.col("dist"), F.col("z")
    (hd, hz), (ld, lz) = WEIGHTS["HF"], WEIGHTS["LF"]
    base = F.when(hf, -dist * hd - z * hz).otherwise(-dist * ld - z * lz)
    return base - F.when(heavy, z * HEAVY_LEVEL_WEIGHT).otherwise(F.lit(0.0))


def class_scores(slots: DataFrame) -> DataFrame:
    """Score of every slot for each of the four product classes (HF/LF, heavy or not)."""
    classes = F.array(
        *[
            F.struct(F.lit(s).alias("segment"), F.lit(h).alias("heavy"))
            for s in ("HF", "LF")
            for h in (False, True)
        ]
    )
    return slots.select("*", F.inline(classes)).withColumn("score", slot_score(F.col("segment") == "HF", F.col("heavy")))


def best_slots(slots: DataFrame, k: int) -> DataFrame:
    """Best k slots per site, type and class; ties go to the lower slot id.

    Spark keeps only k rows per group on the map side (window group limit), so
    a large site is not sorted in one task.
    """
    w = Window.partitionBy("site", "slot_type", "segment", "heavy").orderBy(F.desc("score"), "slot_id")
    return class_scores(slots).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def free_slots(slots: DataFrame, occupied: DataFrame, slot_type: str | None = None) -> DataFrame:
    wanted = slots.where(F.col("slot_type") == slot_type) if slot_type else slots
    return wanted.join(occupied.select("slot_id"), "slot_id", "left_anti")


def occupancy_rate() -> Column:
    return F.coalesce(F.bround(F.try_divide(F.col("occupied"), F.col("total")) * 100, 1), F.lit(0.0))


def occupancy(slots: DataFrame, occupied: DataFrame) -> DataFrame:
    """Total, occupied, free and rate (one digit) per slot type and overall."""
    taken = occupied.select("slot_id").distinct().withColumn("_taken", F.lit(True))
    total, used = F.count("slot_id"), F.count_if(F.coalesce("_taken", F.lit(False)))
    return (
        slots.join(taken, "slot_id", "left")
        .rollup("slot_type")
        .agg(total.alias("total"), used.alias("occupied"))
        .select(
            F.coalesce("slot_type", F.lit("ALL")).alias("slot_type"),
            "total",
            "occupied",
            (F.col("total") - F.col("occupied")).alias("available"),
            occupancy_rate().alias("occupancy_rate"),
        )
    )


def batch_occupancy(slots: DataFrame, held: DataFrame, batch: str = "day") -> DataFrame:
    """Occupancy per type and overall at the end of each batch. ``held``: (batch, slot_id), no repeats."""
    kinds = ("PICKING", "RESERVE")
    size = slots.agg(*[F.count_if(F.col("slot_type") == k).alias(k) for k in kinds], F.count("slot_id").alias("ALL"))
    used = (
        held.join(slots.select("slot_id", "slot_type"), "slot_id")
        .groupBy(batch)
        .agg(*[F.count_if(F.col("slot_type") == k).alias(f"u_{k}") for k in kinds], F.count("slot_id").alias("u_ALL"))
        .withColumns({f"n_{k}": size.select(k).scalar() for k in (*kinds, "ALL")})
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("slot_type"), F.col(f"n_{k}").alias("total"), F.col(f"u_{k}").alias("occupied"))
            for k in (*kinds, "ALL")
        ]
    )
    return used.select(batch, F.inline(rows)).withColumns(
        {
            "available": F.col("total") - F.col("occupied"),
            "occupancy_rate": occupancy_rate(),
        }
    )


def target_type(products: DataFrame, prefer_picking: Column | None = None) -> DataFrame:
    """PICKING for preferred goods and for frequent HF goods, RESERVE for the rest."""
    frequent = (F.col("segment") == "HF") & (F.coalesce("demand_freq", F.lit(0.0)) > PICKING_MIN_FREQUENCY)
    wanted = frequent if prefer_picking is None else (prefer_picking | frequent)
    return products.withColumn("target_type", F.when(wanted, "PICKING").otherwise("RESERVE"))


def assign(
    arrivals: DataFrame,
    slots: DataFrame,
    batch: Sequence[str] = ("day",),
    order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """Give each arrival of a batch one free slot of its site, best slots first.

    Arrivals are numbered per (batch, site, target type), slots per (site, type)
    by score (PICKING with HF weights, RESERVE with LF weights), and equal
    numbers meet. An arrival beyond its type's slots continues in the other
    type's list after that type's own arrivals; if that list is used up too it
    gets no slot (null). Each slot is used at most once per batch: both lists
    are consumed without gaps. ``slots`` are the slots free at the start of every batch.
    """
    best_first = F.when(F.col("slot_type") == "PICKING", slot_score(F.lit(True), F.lit(False))).otherwise(
        slot_score(F.lit(False), F.lit(False))
    )
    # one list per site and type, as long as the building has slots of that type
    by_score = Window.partitionBy("site", "slot_type").orderBy(F.desc("_score"), F.asc("slot_id"))
    listed = slots.withColumn("_score", best_first).withColumn("_slot_no", F.row_number().over(by_score).cast("bigint")).drop("_score")
    sizes = slots.groupBy("site").agg(
        F.count_if(F.col("slot_type") == "PICKING").alias("_n_picking"),
        F.count_if(F.col("slot_type") == "RESERVE").alias("_n_reserve"),
    )
    queue = numbered(arrivals, [*batch, "site", "target_type"], order, "_no")
    demand = arrivals.groupBy(*batch, "site").agg(
        F.count_if(F.col("target_type") == "PICKING").alias("_a_picking"),
        F.count_if(F.col("target_type") == "RESERVE").alias("_a_reserve"),
    )
    picking = F.col("target_type") == "PICKING"
    queue = join_on(queue, demand, [*batch, "site"])
    queue = join_on(queue, F.broadcast(sizes), ["site"], "left")  # one row per site
    own = F.coalesce(F.when(picking, F.col("_n_picking")).otherwise(F.col("_n_reserve")), F.lit(0))
    ahead = F.when(picking, F.col("_a_reserve")).otherwise(F.col("_a_picking"))
    overflow = F.col("_no") > own
    queue = queue.withColumns(
        {
            "slot_type": F.when(overflow, F.when(picking, "RESERVE").otherwise("PICKING")).otherwise(F.col("target_type")),
            "_slot_no": F.when(overflow, ahead + F.col("_no") - own).otherwise(F.col("_no")),
        }
    ).drop("_no", "_a_picking", "_a_reserve", "_n_picking", "_n_reserve")
    return join_on(queue, listed, ["site"], "left", exact=["slot_type", "_slot_no"]).drop("_slot_no")
