"""Slot auctions against all assignments, one-by-one placement, and the rules of a batch."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_warehouse import classes, make_events, slot_table

from skuflow.operators import auction as A
from skuflow.operators import outcomes as O
from skuflow.operators import slots as W


def _best(values, counts):
    goods = [c for c, n in enumerate(counts) for _ in range(n)]
    return max((sum(values[c, s] for c, s in zip(goods, p, strict=True)) for p in itertools.permutations(range(values.shape[1]), len(goods))), default=0)


@pytest.mark.parametrize("seed", range(30))
def test_auction_has_the_greatest_total_value(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(-40, 40 if seed % 2 else -35, (3, 6)) * (1000 if seed % 3 else 1)
    counts = draw.multinomial(draw.integers(0, 7), [0.5, 0.3, 0.2])
    owner = A.auction(values, counts)
    assert np.bincount(owner[owner >= 0], minlength=3).tolist() == counts.tolist()
    assert sum(values[c, s] for s, c in enumerate(owner) if c >= 0) == _best(values, counts)


def test_auction_of_many_equal_slots_ends():
    owner = A.auction(np.zeros((4, 3000), dtype=np.int64) + np.arange(4)[:, None], np.array([700, 800, 900, 100]))
    assert np.bincount(owner[owner >= 0]).tolist() == [700, 800, 900, 100]
    with pytest.raises(ValueError):
        A.auction(np.zeros((1, 2), dtype=np.int64), np.array([3]))


def _value(kind, wanted, segment, heavy, dist, z):
    wd, wz = W.WEIGHTS[segment]
    return A.WANTED_TYPE * (kind == wanted) + 1000 * (-wd * dist - wz * z - (W.HEAVY_LEVEL_WEIGHT * z if heavy else 0))


def test_batches_use_no_slot_twice_and_beat_one_by_one_placement(spark):
    rng = random.Random(3)
    kinds = [rng.choice(["PICKING", "RESERVE"]) for _ in range(40)]
    slots = slot_table(spark, kinds).withColumns({"dist": F.col("slot_id") * 13 % 17 * 1.0, "z": F.col("slot_id") % 4})
    rows = [(rng.randrange(4), rng.randrange(24), "in", 1.0) for _ in range(130)]
    goods = classes(spark, [(s, "HF" if s % 2 else "LF", 0.5 if s % 3 else 0.0, 9.0 if s % 5 < 2 else 1.0) for s in range(24)])
    arrivals = W.target_type(O.with_product_class(make_events(spark, rows), goods))
    got = A.assign_by_auction(arrivals, slots).collect()
    assert len(got) == len(rows)
    table = {r.slot_id: r for r in slots.collect()}
    for day in {r.day for r in got}:
        own = sorted((r for r in got if r.day == day), key=lambda r: (r.ts, r.event_id))
        used = [r.slot_id for r in own if r.slot_id is not None]
        assert len(used) == len(set(used)) == min(len(own), 40)
        assert all(r.slot_id is not None for r in own[:40]) and all(r.slot_id is None for r in own[40:])
        total = sum(_value(table[r.slot_id].slot_type, r.target_type, r.segment, r.heavy, r.dist, r.z) for r in own if r.slot_id is not None)
        free, greedy = dict(table), 0
        for r in own[:40]:
            worth = lambda s: _value(s.slot_type, r.target_type, r.segment, r.heavy, s.dist, s.z)  # noqa: B023, E731
            best = max(free.values(), key=lambda s: (worth(s), -s.slot_id))
            greedy += worth(free.pop(best.slot_id))
        assert total >= greedy
        heavy_high = [r for r in own if r.heavy and r.slot_id is not None and r.z > 0]
        light_low = [r for r in own if not r.heavy and r.slot_id is not None and r.z == 0]
        for h in heavy_high:  # no swap of two goods of one type and segment can help
            assert not any(x.slot_type == h.slot_type and x.segment == h.segment and x.target_type == h.target_type for x in light_low)


def test_unknown_sites_null_keys_and_no_arrivals(spark):
    slots = slot_table(spark, ["PICKING", "RESERVE"])
    events = make_events(spark, [(0, 1, "in", 1.0), (0, 2, "in", 1.0), (1, 1, "in", 1.0), (1, 3, "in", 1.0)])
    events = events.withColumn("site", F.when(F.col("event_id") == 3, None).otherwise(F.col("site"))).withColumn("day", F.when(F.col("event_id") == 2, None).otherwise(F.col("day")))
    arrivals = W.target_type(O.with_product_class(events, classes(spark, [(1, "HF", 0.5, 1.0)])))
    got = {r.event_id: r.slot_id for r in A.assign_by_auction(arrivals, slots).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: None}
    assert A.assign_by_auction(arrivals.limit(0), slots).count() == 0
    assert {r.slot_id for r in A.assign_by_auction(arrivals, slots.limit(0)).collect()} == {None}


def _one_by_one(values, counts):
    """The auction by full sorts of all slots in every round; also the rounds it took."""
    n, scaled = values.shape[1], np.vstack([values - values.min(), np.zeros((1, values.shape[1]), dtype=np.int64)]) * (values.shape[1] + 1)
    counts, price, step = np.append(counts, n - counts.sum()), np.zeros(n, dtype=np.int64), max(1, int(scaled.max()) // 4)
    while True:
        owner, held = np.full(n, -1), np.zeros(len(counts), dtype=np.int64)
        while (held < counts).any():
            bids, bidder = np.full(n, -1), np.full(n, -1)
            for c in np.flatnonzero(held < counts):
                other, k = np.flatnonzero(owner != c), int(counts[c] - held[c])
                net = scaled[c, other] - price[other]
                order = np.argsort(-net, kind="stable")
                for s, worth in zip(other[order[:k]], net[order[:k]], strict=True):
                    offer = price[s] + worth - net[order[min(k, len(order) - 1)]] + step
                    if offer > bids[s]:
                        bids[s], bidder[s] = offer, c
            sold = np.flatnonzero(bidder >= 0)
            price[sold], owner[sold] = bids[sold], bidder[sold]
            held = np.bincount(owner[owner >= 0], minlength=len(counts))
        if step == 1:
            return np.where(owner == len(counts) - 1, -1, owner)
        step = max(1, step // 5)


@pytest.mark.parametrize("seed", range(8))
def test_auction_gives_the_same_slots_as_full_sorts(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 6 if seed % 2 else 5000, (4, 90)) * 1000
    counts = draw.multinomial(90 if seed % 4 < 2 else 61, [0.1, 0.2, 0.3, 0.4])
    assert A.auction(values, counts).tolist() == _one_by_one(values, counts).tolist()


def test_a_round_sorts_no_slots(monkeypatch):
    calls = []
    monkeypatch.setattr(A.np, "argsort", lambda *a, **k: calls.append(1))
    A.auction(np.arange(400, dtype=np.int64).reshape(2, 200), np.array([90, 100]))
    assert not calls


def test_auctions_are_spread_over_tasks(spark):
    slots = slot_table(spark, ["PICKING", "RESERVE"] * 4)
    events = make_events(spark, [(day, 1, "in", 1.0) for day in range(40)])
    arrivals = W.target_type(O.with_product_class(events, classes(spark, [(1, "HF", 0.5, 1.0)])))
    plan = A.assign_by_auction(arrivals, slots)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [day#" in plan.replace("'", "")


@pytest.mark.parametrize("seed", range(4))
def test_rounds_for_the_last_goods_give_the_same_slots(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 9 if seed % 2 else 5000, (4, 400)) * 1000
    counts = draw.multinomial(400 if seed < 2 else 300, [0.05, 0.15, 0.3, 0.5])
    assert A.auction(values, counts).tolist() == _one_by_one(values, counts).tolist()


def test_few_goods_do_not_search_all_slots(monkeypatch):
    calls, search = [], A._largest
    monkeypatch.setattr(A, "_largest", lambda *a: calls.append(1) or search(*a))
    s = np.arange(1000)
    values = 1000 * np.array([-3 * (s % 17) - 5 * (s % 5), -(s % 17) - 2 * (s % 5), -(s % 17) - 12 * (s % 5)])
    values += A.WANTED_TYPE * np.array([s % 5 == 0, s % 5 > 0, s % 5 > 0])
    assert np.bincount(A.auction(values, np.array([180, 500, 320]))).tolist() == [180, 500, 320]
    assert len(calls) < 600  # 1,598 when every round went over all slots, 304 now


def test_lots_meet_in_more_than_one_task(spark, monkeypatch):
    def tasks(keys):
        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            for batch in batches:
                told = [("target_type", "PICKING"), ("segment", "HF"), ("heavy", False), ("_rank", 1), ("slot_id", TaskContext.get().partitionId())]
                columns = [batch.column(k) for k in keys] + [pa.array([v] * batch.num_rows) for _, v in told]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *[n for n, _ in told]])

        return run

    monkeypatch.setattr(A, "_auctions", tasks)
    events = make_events(spark, [(day, 1, "in", 1.0) for day in range(40)])
    arrivals = W.target_type(O.with_product_class(events, classes(spark, [(1, "HF", 0.5, 1.0)])))
    got = [r.slot_id for r in A.assign_by_auction(arrivals, slot_table(spark, ["PICKING"] * 8)).collect()]
    assert len(got) == 40 and len(set(got)) >= 4
