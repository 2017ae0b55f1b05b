"""Weighted rendezvous hashing: rows keep their shard when other shards come or go.

Every (key, shard) pair has a fixed pseudo-random number u in (0, 1); a row goes to the shard with the largest
``weight / -ln(u)``. A new shard can only win rows for itself, a removed shard only loses its own, and the share of a
shard is proportional to its weight. All work is in built-in functions, and no shuffle is needed to place a row.

Defined cases: a null key is replaced by the digest of the text, so that such rows spread over the shards; a null text
has no bytes (size 1, checksum of the empty string); repeated rows share a shard and get slots of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.operators.prefix import numbered
from skuflow.session import materialize


def pull(key: Column, shard: int, weight: float) -> Column:
    """How strongly a shard draws a key: independent of all other shards."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.ln((digits + 0.5) / float(1 << 52))


def winner(key: Column, weights: Mapping[int, float]) -> Column:
    """Shard of a key; ties go to the smaller shard number."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    drawn = [F.struct(pull(key, s, w).alias("pull"), F.lit(-s).alias("less")) for s, w in weights.items()]
    return -F.array_max(F.array(*drawn))["less"]


def shard_rows(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, shard, slot (gapless per shard from 0) and the shard under the ``grown`` weights.

    Slots follow key, checksum and size. They come from running counts over range slices, so a shard with any number
    of rows is numbered by many tasks; rows that agree in everything are told apart by their place in the written table.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("string")
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(body.cast("binary"))))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        named.alias("named"),
    )
    placed = narrow.withColumns({"shard": winner(F.col("named"), weights), "grown_shard": winner(F.col("named"), grown)}).drop("named")
    placed = materialize(placed, "shards").withColumn("place", F.monotonically_increasing_id())
    ranked = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size", "place"], "rank")
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1).alias("slot"), "grown_shard")
