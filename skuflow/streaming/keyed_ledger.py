"""Live FIFO ledger in keyed state: late events inside the watermark are booked in their place.

State per (site, product), in RocksDB: the queue of stored events, oldest first, and the events that wait. An event waits
until the watermark has passed its time; then an event-time timer books what is due in (ts, event_id) order, each
outgoing event on the oldest stored one. A micro-batch touches the keys of its events and of due timers only, and state
holds stored and waiting events, not the history. Events behind the watermark are dropped, as Spark drops late rows.

``ledger`` is the other form: it serves late events after what was stored, without delay, and spreads a busy product
over tasks. Here the bookings of one product follow each other in one task, in the order of their times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skuflow.session import new_shared_path
from skuflow.streaming.ledger import OUTCOME
from skuflow.streaming.warehouse import ROCKSDB

#: Direction of the row that ends a stream; it moves the watermark and is booked nowhere.
CLOSE = "close"


class Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getListState("stored", "event_id long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, direction string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = [(r.at, r.event_id, r.direction) for r in rows if r.direction != CLOSE]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(f[0] for f in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(w) for w in self.waiting.get()), key=lambda w: w[:2]) if self.waiting.exists() else []
        due = [w for w in waiting if w[0] < now]
        if not due:
            return
        later = waiting[len(due) :]
        queue = deque(s[0] for s in self.stored.get()) if self.stored.exists() else deque()
        for _, event, way in due:
            source = None
            if way == "in":
                queue.append(event)
            elif queue:
                source = queue.popleft()
            yield Row(event_id=event, site=key[0], sku=key[1], direction=way, ok=way == "in" or source is not None, in_event=source)
        for state, rows in ((self.stored, [(q,) for q in queue]), (self.waiting, later)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if later:
            self._wake(later[0][0])

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


def ledger(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Outcomes of a stream of ``streaming.ledger.ledger`` rows: event_id, ts, site, sku, direction.

    Events without a time are booked first.
    """
    timed = events.withColumn("ts", F.coalesce("ts", F.lit(0).cast("timestamp"))).withColumn("at", F.unix_micros("ts"))
    return timed.withWatermark("ts", lateness).groupBy("site", "sku").transformWithState(
        statefulProcessor=Ledger(), outputStructType=OUTCOME, outputMode="append", timeMode="EventTime"
    )


def with_end(events: DataFrame) -> tuple[DataFrame, Callable[[datetime], None]]:
    """The stream together with a folder that is still empty, and what writes the last row there: its time lies days
    after the one given, so that everything before it is booked. Call it once the events are drained."""
    spark, folder = events.sparkSession, new_shared_path(events.sparkSession, "end")
    row = {c: F.lit(None).cast(t) for c, t in events.dtypes}
    spark.createDataFrame([], events.schema).write.parquet(folder)

    def end(last: datetime) -> None:
        late = row | {"ts": F.lit(last + timedelta(days=8)).cast("timestamp"), "direction": F.lit(CLOSE)}
        spark.range(1).select(*[late[c].alias(c) for c in events.columns]).write.mode("append").parquet(folder)

    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder)), end


def run_to_table(outcomes: DataFrame, end: Callable[[], None] | None = None, label: str = "keyed-ledger") -> tuple[DataFrame, list[int]]:
    """Drain the stream into a table; gives it and the rows that each micro-batch changed in the state.

    ``end`` is called once all is read; what it adds to the stream is then drained by the same query, resumed.
    """
    spark = outcomes.sparkSession
    out, state = new_shared_path(spark, label), new_shared_path(spark, f"{label}-state")
    key = "spark.sql.streaming.stateStore.providerClass"
    old, changed = spark.conf.get(key), []

    def drain() -> None:
        writer = outcomes.writeStream.outputMode("append").format("parquet").option("path", out)
        query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        changed.extend(sum(int(s["numRowsUpdated"]) for s in p["stateOperators"]) for p in query.recentProgress)

    spark.conf.set(key, ROCKSDB)
    try:
        drain()
        if end is not None:
            end()
            drain()
    finally:
        spark.conf.set(key, old)
    return spark.read.schema(OUTCOME).parquet(out), changed
