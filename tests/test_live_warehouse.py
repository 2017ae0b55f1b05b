"""Days carried by keyed state against a plain loop and against the batch form."""

from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_warehouse import classes, make_events, slot_table

from skuflow.functions import labels as L
from skuflow.operators import outcomes as O
from skuflow.operators import slots as W
from skuflow.streaming import warehouse as LW


def _loop(events, slots):
    """events: (event_id, ts, day, site, sku, way, wanted); slots: (slot_id, site, type, score)."""
    taken, queues, out = set(), {}, {}
    for day in sorted({e[2] for e in events}):
        for site in sorted({e[3] for e in events}):
            own = sorted((e for e in events if e[2] == day and e[3] == site), key=lambda e: (e[1], e[0]))
            free = {k: [s for s, at, kind, score in sorted(slots, key=lambda s: (-s[3], s[0])) if at == site and kind == k and s not in taken] for k in ("PICKING", "RESERVE")}
            ins = {k: [e for e in own if e[5] == "in" and e[6] == k] for k in free}
            chosen = {}
            for k, other in (("PICKING", "RESERVE"), ("RESERVE", "PICKING")):
                spare = free[other][len(ins[other]) :]
                for i, e in enumerate(ins[k]):
                    chosen[e[0]] = free[k][i] if i < len(free[k]) else spare[i - len(free[k])] if i - len(free[k]) < len(spare) else None
            for e in own:
                queue, slot = queues.setdefault((site, e[4]), deque()), None
                if e[5] == "in":
                    slot = chosen[e[0]]
                    if slot is not None:
                        queue.append(slot)
                elif e[5] == "out" and queue:
                    slot = queue.popleft()
                out[e[0]] = slot
        taken = {s for q in queues.values() for s in q}
    return out, taken


def _case(spark, seed, days=9, n=400):
    rng = random.Random(seed)
    rows = [(i * days // n, rng.randrange(12), rng.choice(["in", "in", "out", "odd"]), 1.0) for i in range(n)]
    site = F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).cast("long")
    events = make_events(spark, rows).withColumn("site", site)
    slots = slot_table(spark, [rng.choice(["PICKING", "RESERVE"]) for _ in range(30)]).withColumn("site", (F.col("slot_id") % 2).cast("long"))
    goods = classes(spark, [(s, "HF" if s % 2 else "LF", 0.5, 1.0) for s in range(12)])
    return W.target_type(O.with_product_class(events, goods)), slots


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _expected(events, slots):
    scored = slots.withColumn("score", F.when(F.col("slot_type") == "PICKING", W.slot_score(F.lit(True), F.lit(False))).otherwise(W.slot_score(F.lit(False), F.lit(False))))
    told = [(r.event_id, r.ts, r.day, r.site, r.sku, r.way, r.target_type) for r in events.withColumn("way", L.direction("flow_word")).collect()]
    return _loop(told, [(r.slot_id, r.site, r.slot_type, r.score) for r in scored.collect()])


def test_days_in_files_of_their_own_and_late_events(spark, tmp_path):
    events, slots = _case(spark, 4)
    path = str(tmp_path / "flow")
    late = (F.col("event_id") % 37 == 5) & (F.datediff("day", F.lit("2026-02-15").cast("date")) < 8)
    filed = events.withColumn("file", F.datediff("day", F.lit("2026-02-15").cast("date")) + F.when(late, 1).otherwise(0))
    for k in range(9):  # some events come a day late, inside the watermark
        filed.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(path)
    LW.closing_rows(events, datetime(2026, 2, 15) + timedelta(days=9), path)
    got, state = LW.run_to_table(LW.carried(_stream(spark, path, events.schema), slots, lateness="2 days"))
    rows = got.collect()
    want, taken = _expected(events, slots)
    assert {r.event_id: r.slot_id for r in rows} == want and len(rows) == 400
    assert all(r.success == (r.slot_id is not None) for r in rows)
    assert any(r.direction == "in" and r.slot_id is None for r in rows) and any(r.direction == "out" and r.success for r in rows)
    # the slots of both sites, the occupied ones, queues and open days; nothing of the history
    assert len(taken) <= state <= 6 * 30 + 60


def test_equals_the_batch_form(spark, tmp_path):
    events, slots = _case(spark, 8, days=3, n=90)
    path = str(tmp_path / "flow")
    events.coalesce(2).write.parquet(path)
    LW.closing_rows(events, datetime(2026, 2, 25), path)
    got, _ = LW.run_to_table(LW.carried(spark.readStream.schema(events.schema).parquet(path), slots))
    old, _ = O.carried_events(events, slots)
    assert {r.event_id: r.slot_id for r in got.collect()} == {r.event_id: r.slot_id for r in old.collect()}


def test_a_day_books_overflow_behind_the_other_types_own_arrivals():
    events = [(1, 7, "in", "PICKING"), (2, 7, "in", "PICKING"), (3, 8, "in", "RESERVE"), (4, 9, "in", "RESERVE"), (5, 7, "out", "RESERVE"), (6, 5, "out", "RESERVE"), (7, 1, "unknown", "RESERVE")]
    queues: dict = {}
    assert LW.book_day(events, {"PICKING": [10], "RESERVE": [20, 21, 22]}, queues) == [10, 22, 20, 21, 10, None, None]
    assert {k: list(v) for k, v in queues.items()} == {7: [22], 8: [20], 9: [21]}


def test_all_due_days_are_booked_from_one_reading_of_the_state():
    from collections import Counter
    from types import SimpleNamespace

    from skuflow.streaming import warehouse as live

    calls = Counter()

    class Map(dict):
        def iterator(self):
            calls["read"] += 1
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, k, v):  # noqa: N802
            self[k[0]] = v

        def removeKey(self, k):  # noqa: N802
            del self[k[0]]

        def containsKey(self, k):  # noqa: N802
            return k[0] in self

    class Events(list):
        def get(self):
            calls["open"] += 1
            return iter(list(self))

        def exists(self):
            return bool(self)

        def put(self, rows):
            self[:] = rows

    site = live.Warehouse()
    site.slots, site.taken, site.queues = Map({1: ("PICKING", 2.0), 2: ("PICKING", 1.0)}), Map(), Map()
    ways = [(1, "in"), (1, "in"), (2, "out"), (2, "in"), (3, "out"), (50, "out")]
    site.open = Events((i, i, day, 7, way, "PICKING") for i, (day, way) in enumerate(ways))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10 * live._DAY_MS)
    frames = list(site.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda: 2 * live._DAY_MS)))
    assert [f["day_no"].iloc[0] for f in frames] == [1, 2, 3]
    # slot 1 is let go on day 2, after that day's free slots were counted: the arrival of day 2 finds none
    assert [None if v is live.pd.NA else v for f in frames for v in f["slot_id"]] == [1, 2, 1, None, 2]
    assert calls == {"open": 1, "read": 3}
    assert not site.taken and not site.queues and [e[2] for e in site.open] == [50]


def test_events_wait_in_blocks_and_split_by_day():
    from types import SimpleNamespace

    import pandas as pd

    class Map(dict):
        def iterator(self):
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, k, v):  # noqa: N802
            self[k[0]] = v

        def removeKey(self, k):  # noqa: N802
            del self[k[0]]

    class Events(list):
        def get(self):
            return iter(list(self))

        def exists(self):
            return bool(self)

        def put(self, rows):
            self[:] = rows

        def clear(self):
            self[:] = []

    rng = random.Random(11)
    rows = [(i, 1000 - i % 7, i // 250, rng.choice([None, 1, 2, 3, 2**60]), rng.choice(["in", "out", "unknown"]), rng.choice(["PICKING", "RESERVE"])) for i in range(1000)]

    def site(events):
        made = LW.Warehouse()
        made.slots = Map({s: (("PICKING", "RESERVE")[s % 2], float(s)) for s in range(300)})
        made.taken, made.queues, made.open, made.fresh = Map(), Map(), Events(events), Map()
        return made

    def book(made, day):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: (day + 1) * LW._DAY_MS)
        frames = list(made.handleExpiredTimer((4,), now, SimpleNamespace(getExpiryTimeInMs=lambda: LW._DAY_MS)))
        return [r for f in frames for r in f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)]

    days, packed = set(), site([])
    packed.handle = SimpleNamespace(registerTimer=days.add)
    names = ["event_id", "at", "day_no", "sku", "direction", "target_type"]
    told = pd.DataFrame(rows, columns=names).astype({"sku": "Int64"})
    close = pd.DataFrame([(None, 0, 9, None, "close", "RESERVE")], columns=names)
    assert not list(packed.handleInputRows((4,), iter([told[:600], told[600:], close]), None))
    assert len(packed.fresh) == 2 and not packed.open and days == {(d + 1) * LW._DAY_MS for d in range(4)}
    alone = site(rows)  # every event a state row of its own
    first = book(packed, 2)
    assert len(first) == 750 and first == book(alone, 2) and len(packed.open) == 1 and not packed.fresh
    last = book(packed, 3)
    assert len(last) == 250 and last == book(alone, 3) and not packed.open
    assert {r[0] for r in first + last} == set(range(1000)) and {r[2] for r in first} == {None, 1, 2, 3, 2**60}
    assert packed.taken == alone.taken and packed.queues == alone.queues and packed.taken
