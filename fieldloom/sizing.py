"""Reused summaries and block-wise helpers that keep every task bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Order values per block in block-wise running operators.
BLOCK = 65_536


def reused(df: DataFrame) -> DataFrame:
    """Mark a summary that several later steps read, so that the data behind it is read once.

    Nothing runs until an action needs it.  Blocks that do not fit in memory go to disk, and those
    lost with an executor are computed again.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    block: int = BLOCK,
    depth: int = 2,
) -> DataFrame:
    """Add inclusive running sums along an integer column, without one big window.

    ``order`` must be unique within ``keys``, so a block of ``block`` consecutive
    order values holds at most ``block`` rows.  Rows are summed inside their block;
    block totals are summed the same way one level up (``depth`` levels, then a
    plain window over what is left) and added as an offset.  No task sees a whole
    key, however large the key is.
    """
    keys = list(keys)
    names = list(sums)
    rows = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    if depth == 0:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        out = rows.withColumns({n: F.sum(f"_v_{n}").over(w) for n in names})
        return out.drop(*[f"_v_{n}" for n in names])

    at = f"_block{depth}"  # one name per level: a level's order column is the block below
    # Never NULL, so that no not-null filters are derived per level; they would make the
    # levels' scans differ and keep Spark from reusing one shuffle for all of them.
    in_block = F.floor(F.col(order) / block).cast("long")
    rows = rows.withColumn(at, F.coalesce(in_block, F.lit(-1).cast("long")))
    totals = rows.groupBy(*keys, at).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    upto = running_sums(
        totals, keys, at, {f"_u_{n}": F.col(f"_t_{n}") for n in names}, block, depth - 1
    )
    offsets = upto.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(at).alias("_b"),
        *[(F.col(f"_u_{n}") - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in names],
    )
    w = W.partitionBy(*keys, at).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(w) for n in names})
    on = F.col(at) == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(offsets, on)
    return out.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]
    )


def as_column(value) -> Column:
    """Accept a Column, or turn a Python value into a literal."""
    return value if isinstance(value, Column) else F.lit(value)
