"""Bounded samples by hash, the same whenever they are drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SPAN = 1 << 40


def lowest_hashes(rows: DataFrame, group: str, most: int, keys: Sequence[str]) -> DataFrame:
    """At most ``most`` rows of every ``group`` (few and not NULL): those whose ``keys`` hash lowest.

    Groups are counted first, and only rows below a hash that lets about twice ``most`` of
    a group through are ranked, so that few rows are shuffled however large a group is.
    """
    taken = {c.lower() for c in rows.columns}
    at, nth = (next(n for n in (name, name + "_", name + "__") if n not in taken) for name in ("_at", "_nth"))
    rows = rows.withColumn(at, F.pmod(F.xxhash64(*keys), F.lit(SPAN)))
    counts = rows.groupBy(group).count().collect()  # a row per group
    limit = F.lit(SPAN)
    for row in counts:
        if row["count"] > 2 * most:
            limit = F.when(F.col(group) == row[group], SPAN * 2 * most // row["count"]).otherwise(limit)
    rank = F.row_number().over(W.partitionBy(group).orderBy(at, *keys))
    return rows.where(F.col(at) < limit).withColumn(nth, rank).where(F.col(nth) <= most).drop(at, nth)
