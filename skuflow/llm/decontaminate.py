"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document when at least ``threshold`` of its distinct word shingles occur there; the document
may be far longer. Items are partitioned by their number of shingles. The MinHash sketch of an item is its ``s`` smallest
shingle hashes, where s depends on the partition: an item of n shingles can miss at most ``n - ceil(threshold * n)`` of
them, so with s = that number for the partition's upper size + SPARE at least ``s - missed`` of the sketch must occur in a
document that contains the item. Pairs that fall short are dropped; no pair that qualifies is. The rest are
verified on the shingles themselves.

All work is in built-in functions. Documents meet the sketches in one join on the shingle hash; the sketches are
broadcast only when their number, which is counted, is below BROADCAST, and shuffled otherwise.

Words are lower-cased runs of bytes other than 0x20 and 0x09-0x0D. Defined cases: null and empty texts and items match
nothing; an item of fewer words than a shingle matches only documents with exactly that word sequence; items with equal
word sequences are searched once and reported each; a null key is a key like any other; repeated rows give repeated
pairs only once per key and text; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
SPARE = 6
BROADCAST = 200_000
_GAPS = "[\\x20\\x09-\\x0D]+"


def word_list(text: Column) -> Column:
    """Lower-cased words."""
    return F.array_remove(F.split(F.lower(text), _GAPS), "")


def _shingled(rows: DataFrame, width: int) -> DataFrame:
    """One row per shingle of ``w``: columns s0, s1, ... hold its words. Shorter word lists give one row, padded by null."""
    lanes = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"s{i}") for i in range(width)])
    whole = F.when(F.size("w") < width, F.slice(lanes, 1, 1)).otherwise(F.slice(lanes, 1, F.greatest(F.size("w") - width + 1, F.lit(1))))
    kept = [c for c in rows.columns if c != "w"]
    return rows.where(F.size("w") > 0).select(*kept, F.explode(whole).alias("s")).select(*kept, *[F.col("s")[f"s{i}"].alias(f"s{i}") for i in range(width)])


def contained(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), item_id, found, shingles, containment for every contained item."""
    lanes = [f"s{i}" for i in range(width)]
    listed = items.select(F.col(item).alias("item_id"), word_list(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    listed = materialize(listed.withColumn("class", F.sha2(F.array_join("w", " "), 256)), "items")
    classes = listed.groupBy("class").agg(F.first("w").alias("w"))
    shingles = _shingled(classes, width).distinct().withColumn("hash", F.xxhash64(*lanes))
    sized = shingles.groupBy("class").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("hash")).alias("hashes"))
    # partitions by powers of 1.5: the upper size sets the sketch length of all items of a partition
    step = math.log(1.5)
    sized = sized.withColumn("partition", F.ceil(F.log(F.col("n").cast("double")) / step - 1e-9).cast("int"))
    upper = F.floor(F.exp(F.col("partition") * step) + 1e-6)
    sized = sized.withColumn("missed", F.col("n") - F.ceil(F.col("n") * threshold - 1e-9))
    length = (upper - F.ceil(upper * threshold - 1e-9) + 1 + SPARE).cast("int")
    sized = sized.withColumn("sketch", F.slice("hashes", 1, length)).withColumn("least", F.greatest(F.size("sketch") - F.col("missed"), F.lit(1)))
    sized = materialize(sized.select("class", "n", "sketch", "least"), "sketches")
    sketch = sized.select("class", "least", F.explode("sketch").alias("hash"))
    shingles = materialize(shingles.join(sized.select("class", "n"), "class"), "item-shingles")
    small = shingles.count() <= BROADCAST

    def met(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small else table

    body = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    hashed = _shingled(body.select("doc_id", "h", word_list(F.col("t")).alias("w")), width).select("doc_id", "h", F.xxhash64(*lanes).alias("hash"))
    hits = hashed.join(met(sketch), "hash").select("doc_id", "h", "hash", "class", "least")
    pairs = hits.distinct().groupBy("doc_id", "h", "class", "least").agg(F.count("*").alias("seen")).where(F.col("seen") >= F.col("least"))
    pairs = materialize(pairs.select("doc_id", "h", "class"), "candidates")

    # exact: shingles of candidate documents, as words, against those of their candidate items
    mine = pairs.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    near = body.join(mine, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left_semi")
    words = _shingled(near.select("doc_id", "h", word_list(F.col("t")).alias("w")), width)
    common = words.withColumn("hash", F.xxhash64(*lanes)).alias("d").join(met(shingles).alias("i"), [F.col("d.hash") == F.col("i.hash"), *[F.col(f"d.{c}").eqNullSafe(F.col(f"i.{c}")) for c in lanes]])
    found = common.select("d.doc_id", "d.h", "i.class", "i.n", "i.hash").distinct().groupBy("doc_id", "h", "class", "n").agg(F.count("*").alias("found"))
    agreed = found.where(F.col("found") >= F.ceil(F.col("n") * threshold - 1e-9))
    agreed = agreed.alias("a").join(pairs.alias("p"), F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("a.h") == F.col("p.h")) & (F.col("a.class") == F.col("p.class")), "left_semi")
    out = agreed.join(met(listed.select("class", "item_id")), "class")
    return out.select("doc_id", "h", "item_id", "found", F.col("n").alias("shingles"), (F.col("found") / F.col("n")).alias("containment"))
