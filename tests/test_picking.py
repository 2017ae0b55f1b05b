import random

import pytest
from pyspark.sql import functions as F

from skuflow.operators import picking as P

ITEM = "order_id long, line_no long, sku long, slot_id long, qty double, weight_kg double"
SLOT = "slot_id long, code string, x long, y long, z long, zone string, floor string, slot_type string"


def split_loop(weights, cap, most):
    out, load, number = [], 0.0, 1
    for i, w in enumerate(weights):
        if i and load and load + w > cap and number < most:
            number, load = number + 1, 0.0
        out.append(number)
        load += w
    return out


def tour_loop(items):
    """items: (no, x, y, z); greedy nearest, first on ties; returns item order, distances, way back."""
    pos, left, order, dist = (3, 5, 0), list(items), [], []
    while left:
        best = min(left, key=lambda p: (abs(p[1] - pos[0]) + abs(p[2] - pos[1]) + abs(p[3] - pos[2]), p[0]))
        order.append(best[0])
        dist.append(abs(best[1] - pos[0]) + abs(best[2] - pos[1]) + abs(best[3] - pos[2]))
        pos = best[1:]
        left.remove(best)
    return order, dist, abs(pos[0] - 3) + abs(pos[1] - 5) + abs(pos[2])


@pytest.fixture(scope="module")
def orders():
    rng = random.Random(11)
    places = {s: (rng.randrange(6), rng.randrange(6), rng.randrange(3)) for s in range(25)}
    rows = []
    for o in range(25):
        for n in range(1, 200 if o == 0 else rng.randrange(2, 14)):
            rows.append((o, n, n, rng.randrange(25), float(rng.randrange(1, 30)), rng.choice([0.2, 1.4, 5.0, 9.6, 400.0 if o == 3 else 3.0])))
    return rows, places


def slots(spark, places):
    return spark.createDataFrame([(s, f"S{s}", *p, f"Z{p[2]}", "C1", "PICKING") for s, p in places.items()], SLOT)


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_chariots_equal_loop(spark, orders, most, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ITEMS", 7)
    rows, _ = orders
    got = P.split_chariots(spark.createDataFrame(rows, ITEM), ("line_no",), 300.0, most).collect()
    mine = {(r.order_id, r.item_no): r.chariot for r in got}
    for o in {r[0] for r in rows}:
        weights = [round(r[4] * r[5] * 1000) for r in rows if r[0] == o]
        assert [mine[(o, i + 1)] for i in range(len(weights))] == split_loop(weights, 300_000, most), o
    assert max(mine.values()) <= most


def test_tours_equal_loop(spark, orders):
    rows, places = orders
    located, unknown = P.locate(P.split_chariots(spark.createDataFrame(rows, ITEM), ("line_no",)), slots(spark, places))
    assert unknown.count() == 0
    steps = P.pick_tours(located).collect()
    chariots = {}
    for r in located.collect():
        chariots.setdefault((r.order_id, r.chariot), []).append((r.item_no, r.x, r.y, r.z))
    line_of = {(r[0], r[1]): r for r in rows}
    for key, items in chariots.items():
        order, dist, back = tour_loop(sorted(items))
        mine = sorted((s for s in steps if (s.order_id, s.chariot) == key), key=lambda s: s.step)
        assert [s.step for s in mine] == list(range(1, len(items) + 2))
        assert [s.sku for s in mine[:-1]] == [line_of[(key[0], n)][2] for n in order]
        assert [s.distance for s in mine] == dist + [back]
    totals = {r.order_id: r for r in P.tour_totals(P.pick_tours(located)).collect()}
    assert {r.order_id: r for r in P.order_totals(located).collect()} == totals
    assert sum(t["items"] for t in totals.values()) == len(rows)


def test_five_items(spark):
    places = {398: (3, 6, 0), 404: (5, 5, 0), 407: (9, 5, 0), 1331: (3, 5, 2), 406: (8, 5, 0)}
    items = [(1, n, sku, slot, q, None) for n, (sku, slot, q) in enumerate(
        [(31554, 398, 10.0), (31565, 404, 20.0), (34015, 407, 15.0), (31557, 1331, 5.0), (31993, 406, 8.0)], 1)]
    located, _ = P.locate(P.split_chariots(spark.createDataFrame(items, ITEM), ("line_no",)), slots(spark, places))
    steps = P.pick_tours(located).orderBy("step").collect()
    assert [s.code for s in steps] == ["S398", "S404", "S406", "S407", "S1331", "EXPEDITION"]
    total = P.tour_totals(P.pick_tours(located)).first()
    assert P.order_totals(located).first() == total
    assert (total["items"], total.chariots, total.distance) == (5, 1, 1 + 3 + 3 + 1 + 8 + 2)


def test_unknown_location_and_fallback(spark):
    places = {7: (1, 1, 0), 9: (2, 2, 0)}
    items = spark.createDataFrame([(1, 1, 10, 0, 1.0, 1.0), (1, 2, 11, None, 1.0, 1.0), (1, 3, 12, 99, 1.0, 1.0)], ITEM)
    stored = spark.createDataFrame([(10, 9)], "sku long, stored_slot long")
    known, unknown = P.locate(P.resolve_slots(items, stored, slots(spark, places)), slots(spark, places))
    assert {r.sku: r.slot_id for r in known.collect()} == {10: 9, 11: 7}
    assert [r.sku for r in unknown.collect()] == [12]


def test_trips(spark):
    df = spark.createDataFrame([(7.0, 150.0), (0.0, 100.0), (None, 601.0), (1.0, 0.0)], "weight_kg double, qty double")
    assert [r.t for r in df.select(P.trips().alias("t")).collect()] == [4, 1, 2, 1]


def test_zone_congestion(spark):
    rows = [(1, 1, i, "pick", "A", 0) for i in range(4)] + [(1, 1, 9, "return", "A", 0)] + [(2, 1, i, "pick", "A", 0) for i in range(3)]
    steps = spark.createDataFrame(rows, "order_id long, chariot long, step long, action string, zone string, level long")
    assert [(r.order_id, r.picks) for r in P.zone_congestion(steps).collect()] == [(1, 4)]
    assert P.zone_congestion(steps.withColumn("level", F.lit(1))).count() == 1


def tours_of(located):
    return sorted(map(tuple, P.pick_tours(located).drop("code", "zone").collect()), key=str)


def test_large_orders_are_planned_like_usual_ones(spark, orders, monkeypatch):
    rows, places = orders
    rows = [(None if r[0] == 2 else r[0], *r[1:]) for r in rows if r[0] < 8 and r[1] < 60]
    twice = slots(spark, places).unionByName(slots(spark, {4: places[4]}))  # a slot listed twice
    located, _ = P.locate(P.split_chariots(spark.createDataFrame(rows, ITEM), ("line_no",)), twice)
    located = located.cache()
    steps, stops, totals = tours_of(located), P.tour_stops(located).collect(), P.order_totals(located).collect()
    monkeypatch.setattr(P, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(P, "ROW_ITEMS", 4)
    assert any(s[0] is None for s in steps)
    kept = lambda some: [s[:3] + s[5:] for s in some]  # noqa: E731  a line met twice stands twice, whichever copy is first
    assert sorted(kept(tours_of(located)), key=str) == sorted(kept(steps), key=str)
    assert sorted(P.tour_stops(located).collect(), key=str) == sorted(stops, key=str)
    assert sorted(P.order_totals(located).collect(), key=str) == sorted(totals, key=str)
    again, _ = P.locate(P.split_chariots(spark.createDataFrame(rows, ITEM), ("line_no",)), twice)
    assert sorted(again.select(located.columns).collect(), key=str) == sorted(located.collect(), key=str)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_usual_orders_are_shuffled_once(spark, orders, tmp_path):
    rows, places = orders
    located, _ = P.locate(P.split_chariots(spark.createDataFrame(rows, ITEM), ("line_no",)), slots(spark, places))
    located.write.parquet(str(tmp_path / "located"))
    located = spark.read.parquet(str(tmp_path / "located"))
    assert exchanges(P.zone_congestion(P.pick_tours(located))) == 1
    assert exchanges(P.chariot_totals(P.pick_tours(located))) == 1
    assert exchanges(P.nested_tours(P.tour_stops(located))) == 1
    assert exchanges(P.order_totals(located)) == 1
    split = P.split_chariots(spark.createDataFrame(rows, ITEM), ("line_no",))
    assert exchanges(split) == 1


def test_only_lines_without_a_slot_meet_the_stock(spark):
    items = spark.createDataFrame([(1, 1, 10, 3, 1.0, 1.0), (1, 2, 10, 0, 1.0, 1.0), (1, 3, None, None, 1.0, 1.0)], ITEM)
    stored = spark.createDataFrame([(10, 9)], "sku long, stored_slot long")
    got = P.resolve_slots(items, stored, slots(spark, {5: (1, 1, 0)}))
    assert got.columns == ["sku", "order_id", "line_no", "slot_id", "qty", "weight_kg"]
    assert sorted((r.line_no, r.slot_id) for r in got.collect()) == [(1, 3), (2, 9), (3, 5)]


def test_a_task_holds_a_bounded_number_of_rows(spark, monkeypatch):
    from skuflow.operators import prefix

    monkeypatch.setattr(prefix, "ROWS_PER_TASK", 100)
    df = spark.range(2000).withColumn("k", F.col("id") % 500)
    counted = prefix.spread(df, ["k"], 2000).groupBy("k").count()
    assert counted.rdd.getNumPartitions() == 21 and counted.count() == 500
