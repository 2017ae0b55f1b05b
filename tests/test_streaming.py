from datetime import datetime

from pyspark.sql import functions as F

from skuflow.functions import labels as L
from skuflow.operators import ledger as K
from skuflow.sources import tables as S
from skuflow.streaming import keyed_ledger, movements
from skuflow.streaming import ledger as live


def test_live_ledger_equals_batch(spark, sf):
    stream = live.with_sites(movements.event_stream(spark, sf))
    got = live.run_to_table(live.ledger(stream)).collect()
    batch = K.stock_ledger(S.flow_events(spark, sf).withColumn("direction", L.direction("flow_word"))).cache()
    want = {r.event_id: r.ok for r in batch.where("direction != 'unknown'").collect()}
    pairs = {r.out_event: r.in_event for r in K.fifo_match(batch).collect()}
    assert {r.event_id: r.ok for r in got} == want
    assert {r.event_id: r.in_event for r in got if r.in_event is not None} == pairs


def feed(spark, folder, n, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.mode("append").parquet(folder)


def test_movements_over_several_batches_with_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    day = lambda d, h=1: datetime(2024, 1, d, h)
    feed(spark, folder, 0, [(i, day(1), 1, "click", 1.0, "") for i in range(6)])
    feed(spark, folder, 1, [(10, day(9), 1, "view", 1.0, ""), (11, day(9), 1, "error", 1.0, "")])
    feed(spark, folder, 2, [(21, day(9, 5), 1, "click", 1.0, "")])
    feed(spark, folder, 3, [(20, day(2), 1, "click", 1.0, ""), (22, day(9, 6), 1, "error", 1.0, "")])
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    events = live.with_sites(raw.withColumn("ts", F.col("ts").cast("timestamp")))
    zones = spark.createDataFrame([(1, "Z")], "sku long, zone string")
    got = {str(r.day): (r.n, r.alert) for r in movements.run_to_table(movements.movements(events, zones)).collect()}
    assert got["2024-01-01"] == (6, True) and got["2024-01-09"] == (2, False)
    # late rows are judged by the watermark two batches on: six days behind it is dropped
    assert "2024-01-02" not in got


def test_ledger_state_carries_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, 0, [(1, datetime(2024, 1, 1), 5, "click", 1.0, ""), (2, datetime(2024, 1, 1, 1), 5, "click", 1.0, "")])
    feed(spark, folder, 1, [(3, datetime(2024, 1, 2), 5, "view", 1.0, ""), (4, datetime(2024, 1, 2, 1), 6, "view", 1.0, "")])
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    got = {r.event_id: (r.ok, r.in_event) for r in live.run_to_table(live.ledger(live.with_sites(raw))).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (True, 1), 4: (False, None)}


def test_ledger_serves_a_late_arrival_after_what_was_stored(spark, tmp_path):
    folder = str(tmp_path / "in")
    day = lambda d: datetime(2024, 1, d)
    feed(spark, folder, 0, [(1, day(5), 5, "click", 1.0, "")])
    feed(spark, folder, 1, [(2, day(1), 5, "click", 1.0, ""), (3, day(6), None, "view", 1.0, "")])  # older, but later; and no product
    feed(spark, folder, 2, [(4, day(7), 5, "view", 1.0, ""), (5, day(8), 5, "view", 1.0, ""), (6, day(9), 5, "view", 1.0, "")])
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    got = {r.event_id: (r.ok, r.in_event) for r in live.run_to_table(live.ledger(live.with_sites(raw))).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None), 4: (True, 1), 5: (True, 2), 6: (False, None)}


def test_keyed_ledger_equals_batch_with_late_events(spark, tmp_path):
    """Events come in files of a day each, some of them a day late; the outcome is that of the events in order."""
    import random

    rng = random.Random(6)
    rows = [(i, datetime(2024, 1, 1 + i // 60, (i % 60) // 3, i % 60), rng.randrange(5) if i % 50 else None, rng.choice(["click", "click", "view", "view", "error"]), 1.0, "") for i in range(480)]
    folder = str(tmp_path / "in")
    file_of = lambda r: r[0] // 60 + (1 if r[0] % 17 == 4 and r[0] < 420 else 0)
    for k in range(8):
        feed(spark, folder, k, rng.sample(own := [r for r in rows if file_of(r) == k], len(own)))
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    events, end = keyed_ledger.with_end(live.ledger(live.with_sites(raw)))
    got, changed = keyed_ledger.run_to_table(keyed_ledger.ledger(events, lateness="2 days"), lambda: end(datetime(2024, 1, 9)))
    queues, want = {}, {}
    for i, _, user, kind, *_ in rows:
        if kind == "error":
            continue
        queue = queues.setdefault(user, [])
        if kind == "click":
            queue.append(i)
        want[i] = (kind == "click" or bool(queue), queue.pop(0) if kind == "view" and queue else None)
    assert {r.event_id: (r.ok, r.in_event) for r in got.collect()} == want
    assert max(changed) < 480  # no batch writes the whole history


def test_keyed_ledger_drops_what_comes_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    day = lambda d: datetime(2024, 1, d)
    feed(spark, folder, 0, [(1, day(10), 5, "click", 1.0, "")])
    feed(spark, folder, 1, [(2, day(11), 5, "click", 1.0, "")])
    feed(spark, folder, 2, [(3, day(1), 5, "click", 1.0, ""), (4, day(12), 5, "view", 1.0, "")])
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    events, end = keyed_ledger.with_end(live.ledger(live.with_sites(raw)))
    booked, _ = keyed_ledger.run_to_table(keyed_ledger.ledger(events), lambda: end(day(12)))
    got = {r.event_id: (r.ok, r.in_event) for r in booked.collect()}
    assert got == {1: (True, None), 2: (True, None), 4: (True, 1)}
