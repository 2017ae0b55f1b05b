"""Running sums per key that do not put a whole key into one task.

A plain window over a hot key sorts all its rows in a single task. Here the rows
are range-partitioned by (keys, order), so a hot key spreads over many slices of
even size; each slice gets its local running values, one summary row per
(key, slice) carries the totals forward, and the carry is joined back. The
summary has at most (#keys + #slices) rows.

Slice numbers come from sampled range bounds, so they are written to the shared
folder before they are used twice: a recomputed task must see the same slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.session import materialize

SLICE = "_slice"
ROWS_PER_TASK = 1_000_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", exact: Sequence[str] = ()) -> DataFrame:
    """Join on ``keys`` where a null key equals a null key, and on ``exact`` where it equals nothing.

    The result has the columns of ``left``, then those of ``right`` that are no keys.
    """
    both = [*keys, *exact]
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in both})
    match = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys] + [F.col(k) == F.col(f"_right_{k}") for k in exact]
    joined = left.join(renamed, reduce(lambda a, b: a & b, match), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in both])


def spread(df: DataFrame, keys: Sequence[str], rows: int, per_task: int | None = None) -> DataFrame:
    """Partition by ``keys`` into the usual number of tasks, or more where a task would get over ``per_task`` of ``rows``
    (ROWS_PER_TASK by default).

    Adaptive execution joins small partitions by their compressed size, which says little about how many rows a sort
    or a hash table has to hold. It leaves a given number as it is, so memory of a task stays bounded at any size.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # never just the usual number: rows that already lie so would keep their partitions, which can still be joined
    return df.repartition(max(usual, rows // (per_task or ROWS_PER_TASK)) + 1, *keys)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    lows: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums, and running minima of such sums.

    ``sums`` maps an output name to the value summed along ``order`` within
    ``keys`` (non-null). ``lows`` maps an output name to a name in ``sums``: the
    minimum of that running sum over the rows before (null on a key's first
    row). ``order`` must be a total order. A null key is a key of its own: no row is lost.
    """
    lows = dict(lows or {})
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    inputs = {f"_v_{n}": v for n, v in sums.items()}
    sliced = materialize(
        df.withColumns(inputs)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn(SLICE, F.spark_partition_id()),
        "running",
    )

    inner = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({n: F.sum(f"_v_{n}").over(inner) for n in sums})
    if lows:
        earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
        local = local.withColumns({n: F.min(of).over(earlier) for n, of in lows.items()})

    totals = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    bottoms = [F.min(of).alias(f"_b_{n}") for n, of in lows.items()]
    summary = (local if lows else sliced).groupBy(*keys, SLICE).agg(*totals, *bottoms)

    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums})
    if lows:
        carry = carry.withColumns(
            {f"_m_{n}": F.min(F.col(f"_b_{n}") + F.col(f"_c_{of}")).over(before) for n, of in lows.items()}
        )
    carry = carry.select(*keys, SLICE, *[f"_c_{n}" for n in sums], *[f"_m_{n}" for n in lows])

    joined = join_on(local, carry, keys, exact=[SLICE])
    shifted_lows = {n: F.least(F.col(n) + F.col(f"_c_{of}"), F.col(f"_m_{n}")) for n, of in lows.items()}
    shifted_sums = {n: F.col(n) + F.col(f"_c_{n}") for n in sums}
    return joined.select(
        *df.columns,
        *[c.alias(n) for n, c in shifted_sums.items()],
        *[c.alias(n) for n, c in shifted_lows.items()],
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """1-based row number per key, free of hot-key tasks."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})
