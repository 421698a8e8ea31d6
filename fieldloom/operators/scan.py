"""Running compositions along an ordered series, in parallel and in the JVM.

The series is cut by range into sorted partitions, so every row gets a place however sparse its
order column is.  Blocks of consecutive places are summarised on their own; summaries are
combined in groups, groups in groups of groups, and so on, until one is left; then every level
hands down what comes before its members.  No group holds more than a block's or a level's
members, so no task sees a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sizing import reused

#: Bits of a place within its partition, as Spark numbers rows.
WITHIN = 33
#: Members of a group of a level, as bits.
LEVEL = 12


def placed(rows: DataFrame, keys: Sequence[str], order: str, block: int) -> tuple[DataFrame, list[int]]:
    """Add ``_block``, ascending along ``keys`` and ``order``, with at most ``block`` rows of one partition.

    Also gives the bits by which a block's number shrinks from level to level, up to a single group.
    """
    if block < 1:
        raise ValueError("block must be at least 1")
    ranged = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    # The bounds are drawn once: all later steps read the same places.
    ranged = reused(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", WITHIN)
    nth = F.shiftright(F.col("_place").bitwiseAND(F.lit((1 << WITHIN) - 1)), block.bit_length() - 1)
    last_part, last_nth = ranged.agg(F.max(part), F.max(nth)).first()
    bits = (last_nth or 0).bit_length()
    total = bits + (last_part or 0).bit_length()
    numbered = ranged.withColumn("_block", F.shiftleft(part, bits).bitwiseOR(nth)).drop("_place")
    return numbered, [min(LEVEL, total - at) for at in range(0, total, LEVEL)] or [1]


def carried(parts: DataFrame, keys: Sequence[str], first: Column, combine: Callable[[Column, Column], Column],
            steps: Sequence[int]) -> DataFrame:
    """For every (``keys``, ``_block``) with a summary ``_m``: ``_before``, the summaries of all blocks before it combined.

    ``combine(a, b)`` is associative, ``b`` coming after ``a``; ``first`` is its neutral element.
    """
    keys = list(keys)
    up = F.shiftright("_block", steps[0])
    group = parts.groupBy(*keys, up.alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_block", "_m"))).alias("_l"))
    if len(steps) > 1:
        totals = group.select(*keys, F.col("_up").alias("_block"), F.aggregate("_l", first, lambda acc, x: combine(acc, x["_m"])).alias("_m"))
        above = carried(totals, keys, first, combine, steps[1:]).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), "_before")
        on = F.col("_up") == F.col("_b")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        group = group.join(above, on)
    else:
        group = group.withColumn("_before", first)
    start = F.struct(F.col("_before").alias("s"), F.slice(F.array(F.col("_before")), 1, 0).alias("out"))
    step = lambda acc, x: F.struct(combine(acc["s"], x["_m"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    befores = F.aggregate("_l", start, step, lambda acc: acc["out"])
    member = F.explode(F.arrays_zip(F.transform("_l", lambda x: x["_block"]).alias("b"), befores.alias("m"))).alias("_z")
    return group.select(*keys, member).select(*keys, F.col("_z.b").alias("_block"), F.col("_z.m").alias("_before"))


def with_carried(rows: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join ``_before`` to what has the same ``keys`` and ``_block``; NULL keys match."""
    side = before.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), "_before")
    on = F.col("_block") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(side, on).drop("_b", *[f"_k_{k}" for k in keys])
