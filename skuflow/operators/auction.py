"""Slot assignment by auction: weight, segment and wanted type of all arrivals of a batch decide together.

``slots.assign`` ranks the slots of a type once, for one class of goods. Here every class (wanted type, segment, heavy)
has its own value for every slot, and the classes of a batch and site bid against each other: a class with goods left
bids for the slots that are worth most to it at their present prices, offers so much that it would still rather have
them than its next choice, and the highest bid takes a slot over, whose former holder bids again. Values are whole
numbers scaled so that the last, smallest increment cannot cost a unit: the assignment has the greatest total value.

Only counts per class enter an auction (eight classes at most), and a site's slots, which the building bounds. The
arrivals themselves are numbered within their class by running counts and meet the slots their class won, best first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.operators.prefix import join_on, numbered
from skuflow.operators.slots import HEAVY_KG, HEAVY_LEVEL_WEIGHT, WEIGHTS, slot_score

CLASS = ["target_type", "segment", "heavy"]
#: A slot of the wanted type is worth more than any difference of scores, in thousandths of a score.
WANTED_TYPE = 10_000_000
_GRAIN = 1000
#: Marks a class's own slots among its values, and up to how many places are found one by one.
_OWN, _FEW = np.iinfo(np.int64).min, 16
#: Rounds go over all slots while more than this part of the goods is left.
_MANY = 50


def _largest(net: np.ndarray, k: int, n: int) -> tuple[np.ndarray, int]:
    """Places of the ``k`` largest of ``n`` values, the earliest on a tie, and the value that follows them (the least,
    if none does). Places that do not count hold ``_OWN``. Found by selection, without sorting."""
    few = min(k, n)
    if few <= _FEW:
        places, worth = [], []
        for _ in range(few):
            places.append(int(net.argmax()))
            worth.append(net[places[-1]])
            net[places[-1]] = _OWN
        following = int(net.max()) if k < n else int(worth[-1])
        net[places] = worth
        return np.array(places), following
    if k >= n:
        places = np.flatnonzero(net != _OWN)
        return places, int(net[places].min())
    parted = np.partition(net, [len(net) - k - 1, len(net) - k])
    last, following = parted[len(net) - k], parted[len(net) - k - 1]
    sure = np.flatnonzero(net > last)
    return np.concatenate([sure, np.flatnonzero(net == last)[: k - len(sure)]]), int(following)


def auction(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Owner class of every slot (-1: none) with the greatest total value.

    ``values`` are whole numbers per class and slot; ``counts``, in all no more than the slots, say how many slots each
    class needs. Slots that stay free are held by one more class, to which all are worth the same. Increments shrink
    from a fraction of the largest difference to one; prices carry over, owners start anew. Rounds that sell many slots
    go over all of them; once few goods are left, whose number never grows again, ``_last_rounds`` ends the phase.
    """
    need, n_slots = int(counts.sum()), values.shape[1]
    if need > n_slots:
        raise ValueError("more goods than slots")
    if not need:
        return np.full(n_slots, -1)
    scaled = np.vstack([values - values.min(), np.zeros((1, n_slots), dtype=np.int64)]) * (n_slots + 1)
    counts = np.append(counts, n_slots - need)
    worth = scaled.tolist()
    price = np.zeros(n_slots, dtype=np.int64)
    bids, bidder = np.full(n_slots, -1, dtype=np.int64), np.full(n_slots, -1)
    step = max(1, int(scaled.max()) // 4)
    while True:
        owner = np.full(n_slots, -1)
        held = np.zeros(len(counts), dtype=np.int64)
        net = scaled - price
        while (counts - held).sum() > n_slots // _MANY:
            asked = []
            for c in np.flatnonzero(held < counts).tolist():
                wanted, following = _largest(net[c], int(counts[c] - held[c]), n_slots - int(held[c]))
                offer = price[wanted] + net[c, wanted] - following + step
                better = offer > bids[wanted]
                bids[wanted[better]], bidder[wanted[better]] = offer[better], c
                asked.append(wanted)
            sold = np.unique(np.concatenate(asked))
            winner, loser = bidder[sold], owner[sold]
            held += np.bincount(winner, minlength=len(counts)) - np.bincount(loser[loser >= 0], minlength=len(counts))
            price[sold], owner[sold] = bids[sold], winner
            net[:, sold] = scaled[:, sold] - price[sold]
            net[winner, sold] = _OWN
            bids[sold], bidder[sold] = -1, -1
        price, owner = _last_rounds(worth, counts, held, net, price, owner, step)
        if step == 1:
            return np.where(owner == len(counts) - 1, -1, owner)
        step = max(1, step // 5)


def _last_rounds(
    worth: list[list[int]], counts: np.ndarray, held: np.ndarray, net: np.ndarray, price: np.ndarray, owner: np.ndarray, step: int
) -> tuple[np.ndarray, np.ndarray]:
    """Prices and owners after the rounds in which few goods are left, at a cost that follows from the bids alone.

    A class keeps the slots it does not own in a heap, best first and the earliest on a tie. Prices only rise, so an
    entry can say too much but never too little: it is put right when it comes to the top.
    """
    n_slots, left = net.shape[1], (counts - held).tolist()
    if not any(left):
        return price, owner
    heaps: list[list[int]] = []
    for row in net:  # value and place in one whole number, which Python lets grow as it must
        heap = [-v * n_slots + s for s, v in enumerate(row.tolist()) if v != _OWN]
        heapify(heap)
        heaps.append(heap)
    cost, holder = price.tolist(), owner.tolist()
    short = [c for c, k in enumerate(left) if k > 0]
    while short:
        best: dict[int, tuple[int, int]] = {}
        asked = []
        for c in short:
            heap, mine = heaps[c], worth[c]
            wanted = []
            for _ in range(min(left[c], len(heap))):
                while True:
                    key = heap[0]
                    place = key % n_slots
                    now = (cost[place] - mine[place]) * n_slots + place
                    if key == now:
                        break
                    heapreplace(heap, now)
                heappop(heap)
                wanted.append(place)
            while heap:
                key = heap[0]
                place = key % n_slots
                now = (cost[place] - mine[place]) * n_slots + place
                if key == now:
                    break
                heapreplace(heap, now)
            if not heap:  # nothing follows: the least of those wanted
                place = wanted[-1]
            least = mine[place] - cost[place] - step
            for s in wanted:
                offer = mine[s] - least
                if s not in best or offer > best[s][0]:
                    best[s] = offer, c
            asked.append((c, wanted))
        for s, (offer, c) in best.items():
            loser, holder[s], cost[s] = holder[s], c, offer
            left[c] -= 1
            if loser >= 0:
                left[loser] += 1
                heappush(heaps[loser], (offer - worth[loser][s]) * n_slots + s)
        for c, wanted in asked:
            for s in wanted:
                if holder[s] != c:
                    heappush(heaps[c], (cost[s] - worth[c][s]) * n_slots + s)
        short = [c for c, k in enumerate(left) if k > 0]
    return np.array(cost), np.array(holder)


def _values(classes: list[dict], kinds: np.ndarray, dist: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Score of every slot for every class in thousandths, and what the wanted type adds."""
    rows = []
    for c in classes:
        by_dist, by_level = WEIGHTS["HF" if c["segment"] == "HF" else "LF"]
        score = -by_dist * dist - by_level * z - (HEAVY_LEVEL_WEIGHT * z if c["heavy"] else 0.0)
        rows.append(np.rint(score * _GRAIN).astype(np.int64) + WANTED_TYPE * (kinds == c["target_type"]))
    return np.array(rows)


def _auctions(keys: Sequence[str]):
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lots, stocks = batch.column("classes"), batch.column("slots")
            for i in range(batch.num_rows):  # a site's slots are unpacked, and those won given out, one lot at a time
                out = {c: [] for c in (*CLASS, "_rank", "slot_id")}
                slots = sorted(stocks[i].as_py(), key=lambda s: s["slot_id"])
                classes = sorted(lots[i].as_py(), key=lambda c: tuple(c[x] for x in CLASS))
                values = _values(classes, *(np.array([s[k] for s in slots]) for k in ("slot_type", "dist", "z")))
                owner = auction(values, np.array([c["n"] for c in classes]))
                for k, c in enumerate(classes):
                    won = np.flatnonzero(owner == k)
                    for rank, s in enumerate(won[np.argsort(-values[k, won], kind="stable")].tolist()):
                        for x in CLASS:
                            out[x].append(c[x])
                        out["_rank"].append(rank + 1)
                        out["slot_id"].append(slots[s]["slot_id"])
                source = pa.array(np.full(len(out["slot_id"]), i))
                columns = [batch.column(k).take(source) for k in keys]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=[*keys, *out])

    return run


def assign_by_auction(
    arrivals: DataFrame, slots: DataFrame, batch: Sequence[str] = ("day",), order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """Give the arrivals of a batch the free slots of their site with the greatest total value.

    ``arrivals`` have target_type, segment and weight_kg, ``slots`` are those free at the start of every batch. Where a
    site has fewer slots than arrivals, the first by ``order`` get one; the others, and those of unknown sites, get
    none (null). A slot is used at most once a batch. The wanted type comes first; among assignments with as many
    goods in their wanted type the one with the greatest total score is made. Null batches and sites are their own.
    """
    keys = [*batch, "site"]
    classed = arrivals.withColumns(
        {"segment": F.coalesce("segment", F.lit("LF")), "heavy": F.coalesce(F.col("weight_kg") > HEAVY_KG, F.lit(False))}
    )
    stock = slots.groupBy("site").agg(
        F.collect_list(F.struct("slot_id", "slot_type", F.col("dist").cast("double").alias("dist"), F.col("z").cast("double").alias("z"))).alias("slots")
    )
    sizes = slots.groupBy("site").agg(F.count("slot_id").alias("_size"))
    queue = join_on(numbered(classed, keys, order, "_no"), F.broadcast(sizes), ["site"], "left")  # one row per site
    queue = queue.withColumn("_served", F.coalesce(F.col("_no") <= F.col("_size"), F.lit(False))).drop("_no", "_size")
    queue = numbered(queue, [*keys, *CLASS, "_served"], order, "_rank")
    counts = queue.where("_served").groupBy(*keys, *CLASS).agg(F.count(F.lit(1)).alias("n"))
    lots = counts.groupBy(*keys).agg(F.collect_list(F.struct(*CLASS, "n")).alias("classes"))
    types = ", ".join(f"`{k}` {queue.schema[k].dataType.simpleString()}" for k in keys)
    # few small rows that each take long: adaptive execution would merge them into one task, also where they are already
    # partitioned so into the usual number; several tasks a core even out how many lots each gets
    tasks = 4 * int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    won = join_on(lots, stock, ["site"]).select(*keys, "classes", "slots").repartition(tasks, *keys).mapInArrow(
        _auctions(keys), f"{types}, target_type string, segment string, heavy boolean, _rank bigint, slot_id bigint"
    )
    placed = join_on(queue, won.withColumn("_served", F.lit(True)), keys, "left", exact=[*CLASS, "_served", "_rank"]).drop("_served", "_rank")
    found = placed.join(slots.drop("site"), "slot_id", "left")
    return found.withColumn("score", F.when(F.col("slot_id").isNotNull(), slot_score(F.col("segment") == "HF", F.col("heavy"))))
