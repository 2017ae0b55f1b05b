"""Warehouse days carried by the event stream: each day starts from the slots the day before left.

One keyed state per site, in RocksDB: the site's slots, a map of occupied slots, a first-in first-out queue of slots per
product, and the events of days that are still open. An event-time timer closes a day once the watermark has passed its
end: the day's arrivals are placed on the slots that were free at its start (as ``slots.assign`` places a batch), then
all its events are booked in (ts, event_id) order, each outgoing one on its product's oldest slot. So events that come
late, but inside the watermark, are booked in their place; later ones are dropped, as Spark drops late rows.

State grows with the occupied slots, the products in stock and the open days, not with the history. Open events are
kept in blocks, one state row for those that came in one frame, since a state row costs far more than an event.
Days of a site follow from each other, so a site is one key; sites are spread over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

from skuflow.functions.labels import direction
from skuflow.operators.slots import slot_score
from skuflow.session import new_shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "event_id bigint, day_no int, sku bigint, site bigint, direction string, slot_id bigint, success boolean"
_DAY_MS = 86_400_000
#: Word of the event that ends the stream: it moves the watermark and is booked nowhere.
CLOSE = "\x00close"
_TYPES = ("PICKING", "RESERVE")
#: Columns of a block of events, each packed into bytes. Words are told apart by their first letters.
_BLOCK = {"event_id": "i8", "at": "i8", "day_no": "i4", "sku": "i8", "direction": "S1", "target_type": "S1"}
_WORDS = {w[0].encode(): w for w in ("in", "out", "unknown", *_TYPES)}
#: Stands for null among whole numbers.
_NULL = np.iinfo(np.int64).min


def _numbers(column: pd.Series) -> np.ndarray:
    if column.dtype.kind == "f":  # a frame with a null in this column has it as floats, which the state took for null
        return np.full(len(column), _NULL)
    return column.astype("Int64").to_numpy("int64", na_value=_NULL)


def _nullable(numbers: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(numbers, numbers == _NULL)


def _packed(columns: Iterable[np.ndarray]) -> tuple[bytes, ...]:
    return tuple(c.astype(kind).tobytes() for c, kind in zip(columns, _BLOCK.values(), strict=True))


def _unpacked(block: tuple) -> list[np.ndarray]:
    """Columns of a block; it may also hold a single event as plain values."""
    return [
        np.frombuffer(cell, kind) if isinstance(cell, bytes | bytearray) else np.array([_NULL if cell is None else cell], kind)
        for cell, kind in zip(block, _BLOCK.values(), strict=True)
    ]


def book_day(events: list[tuple], free: dict[str, list[int]], queues: dict[int, deque]) -> list[int | None]:
    """Slot of every event of a day. ``events``: (event_id, sku, direction, target_type) in order; ``free``: the free
    slots per type, best first; ``queues``: occupied slots per product, oldest first (changed here)."""
    arrivals = {k: sum(1 for e in events if e[2] == "in" and e[3] == k) for k in _TYPES}
    seen = dict.fromkeys(_TYPES, 0)
    out: list[int | None] = []
    for _, sku, way, wanted in events:
        slot = None
        if way == "in":
            place, kind = seen[wanted], wanted
            seen[wanted] += 1
            if place >= len(free[wanted]):  # behind the other type's own arrivals
                kind = _TYPES[1 - _TYPES.index(wanted)]
                place = arrivals[kind] + place - len(free[wanted])
            slot = free[kind][place] if place < len(free[kind]) else None
            if slot is not None:
                queues.setdefault(sku, deque()).append(slot)
        elif way == "out" and queues.get(sku):
            slot = queues[sku].popleft()
        out.append(slot)
    return out


@dataclass
class Stock:
    """What a site holds while its due days are booked: slots best first with their type, taken slots, queues, which of
    them have changed, and which the state has."""

    ranked: list[tuple[int, str]]
    taken: dict[int, int | None]
    queues: dict[int | None, list[int]]
    kept_slots: set[int]
    kept_skus: set[int | None]
    touched_slots: set[int] = field(default_factory=set)
    touched_skus: set[int | None] = field(default_factory=set)


class Warehouse(StatefulProcessor):
    #: Blocks that came in since the site was last booked; ``open`` has what was left over then. RocksDB holds a list as
    #: one value, and now and then reads what lies around a key it looks for, so the many blocks are a map's entries.
    fresh: MapState | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot_id long", "slot_type string, score double")
        self.taken = handle.getMapState("taken", "slot_id long", "sku long")
        self.queues = handle.getMapState("queues", "sku long", "slots array<long>")
        self.fresh = handle.getMapState("fresh", "block string", ", ".join(f"{c} binary" for c in _BLOCK))
        self.open = handle.getListState("open", ", ".join(f"{c} binary" for c in _BLOCK))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        frames = [initialState] if isinstance(initialState, pd.DataFrame) else initialState
        for frame in frames:
            for slot, kind, score in zip(frame["slot_id"], frame["slot_type"], frame["score"], strict=True):
                self.slots.updateValue((int(slot),), (kind, float(score)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days: set[int] = set()
        for frame in rows:
            frame = frame[frame["direction"] != "close"]
            if len(frame):
                columns = [frame[c].to_numpy() if kind == "S1" else _numbers(frame[c]) for c, kind in _BLOCK.items()]
                self.fresh.updateValue((uuid4().hex,), _packed(columns))
                days |= set(frame["day_no"].unique().tolist())
        for day in days:
            self.handle.registerTimer((int(day) + 1) * _DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # every day the watermark has passed is booked at its first timer, so the open events are read once, not once a day
        ended = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // _DAY_MS - 1
        due, rest = [], []
        for block in self._waiting():
            columns = _unpacked(block)
            past = columns[2] <= ended
            if past.any():
                due.append([c[past] for c in columns])
            if not past.all():
                rest.append(_packed(c[~past] for c in columns) if past.any() else tuple(block))
        if not due:
            return
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        if self.fresh is not None:
            self.fresh.clear()
        del rest
        events = [np.concatenate(c) for c in zip(*due, strict=True)]
        del due
        order = np.lexsort((events[0], events[1], events[2]))
        events = [c[order] for c in events]
        stock = self._load()
        starts = np.unique(events[2], return_index=True)[1].tolist()
        for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
            yield self._book(stock, key[0], [c[start:end] for c in events])
        self._store(stock)

    def _waiting(self) -> Iterator[tuple]:
        if self.open.exists():
            yield from self.open.get()
        if self.fresh is not None:
            for _, block in self.fresh.iterator():
                yield block

    def _load(self) -> Stock:
        """The site's state, at most an entry per slot of each kind: read and written once for all days that are due."""
        ranked = sorted((-score, slot, kind) for (slot,), (kind, score) in self.slots.iterator())
        taken = {k[0]: v[0] for k, v in self.taken.iterator()}
        queues = {k[0]: list(v[0]) for k, v in self.queues.iterator()}
        return Stock([(slot, kind) for _, slot, kind in ranked], taken, queues, set(taken), set(queues))

    def _store(self, stock: Stock) -> None:
        for slot in stock.touched_slots:
            if slot in stock.taken:
                self.taken.updateValue((slot,), (stock.taken[slot],))
            elif slot in stock.kept_slots:
                self.taken.removeKey((slot,))
        for sku in stock.touched_skus:
            if stock.queues.get(sku):
                self.queues.updateValue((sku,), (stock.queues[sku],))
            elif sku in stock.kept_skus:
                self.queues.removeKey((sku,))

    def _book(self, stock: Stock, site: int | None, due: list[np.ndarray]) -> pd.DataFrame:
        lists: dict[str, list[int]] = {k: [] for k in _TYPES}
        for slot, kind in stock.ranked:
            if slot not in stock.taken:
                lists[kind].append(slot)
        event_id, _, day_no, sku_no, way, wanted = due
        skus = [None if k == _NULL else k for k in sku_no.tolist()]
        ways = [_WORDS[w] for w in way.tolist()]
        events = list(zip(event_id.tolist(), skus, ways, map(_WORDS.get, wanted.tolist()), strict=True))
        before = {sku: stock.queues[sku] for sku in set(skus) - {None} if sku in stock.queues}
        queues = {sku: deque(v) for sku, v in before.items()}
        slots = book_day(events, lists, queues)
        for sku, queue in queues.items():
            old, new = before.get(sku, []), list(queue)
            if new == old:
                continue
            for s in set(old) - set(new):
                stock.taken.pop(s, None)
            for s in set(new) - set(old):
                stock.taken[s] = sku
            stock.touched_slots |= set(old) ^ set(new)
            if new:
                stock.queues[sku] = new
            elif old:
                stock.queues.pop(sku)
            stock.touched_skus.add(sku)
        frame = pd.DataFrame({"event_id": _nullable(event_id), "day_no": day_no, "sku": _nullable(sku_no)})
        frame["site"] = pd.array([site] * len(frame), dtype="Int64")
        frame["direction"], frame["slot_id"] = ways, pd.array(slots, dtype="Int64")
        frame["success"] = [s is not None for s in slots]
        return frame

    def close(self) -> None:
        pass


def carried(events: DataFrame, slots: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Outcome of every event of a stream with ts, event_id, sku, site, flow_word and target_type.

    ``slots`` are the site's empty slots at the start. Events without a time belong to the first day there is.
    """
    first = F.lit(0).cast("timestamp")
    rows = events.withColumns(
        {"ts": F.coalesce(F.col("ts").cast("timestamp"), first), "direction": F.when(F.col("flow_word") == CLOSE, "close").otherwise(direction("flow_word"))}
    )
    keyed = rows.select("event_id", "ts", F.unix_micros("ts").alias("at"), F.unix_date(F.to_date("ts")).alias("day_no"), "sku", "site", "direction", "target_type")
    score = F.when(F.col("slot_type") == "PICKING", slot_score(F.lit(True), F.lit(False))).otherwise(slot_score(F.lit(False), F.lit(False)))
    start = slots.select("site", "slot_id", "slot_type", score.alias("score")).groupBy("site")
    return keyed.withWatermark("ts", lateness).groupBy("site").transformWithStateInPandas(
        statefulProcessor=Warehouse(), outputStructType=OUTCOME, outputMode="append", timeMode="EventTime", initialState=start
    )


def closing_rows(events: DataFrame, last: datetime, folder: str) -> None:
    """Write the file that ends a stream in ``folder``: its time lies past every day, so that timers close them all.

    ``events`` gives the columns; ``last`` is no earlier than any event.
    """
    row = {c: F.lit(None).cast(t) for c, t in events.dtypes}
    row |= {"ts": F.lit(last + timedelta(days=4)).cast(events.schema["ts"].dataType), "flow_word": F.lit(CLOSE)}
    events.sparkSession.range(1).select(*[row[c].alias(c) for c in events.columns]).write.mode("append").parquet(folder)


def run_to_table(outcomes: DataFrame, label: str = "carried") -> tuple[DataFrame, int]:
    """Drain the stream into a table; gives it and the rows the state held at the end.

    A batch without rows follows the last one, since the watermark has moved; its timers close the last days.
    """
    spark = outcomes.sparkSession
    out, key = new_shared_path(spark, label), "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        query = (
            outcomes.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", new_shared_path(spark, f"{label}-state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(key, old)
    state = max((s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"]), default=0)
    rows = spark.read.schema(OUTCOME).parquet(out)
    return rows.withColumn("day", F.date_from_unix_date("day_no")).drop("day_no"), int(state)

