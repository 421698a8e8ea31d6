"""Sharding by a lookup table that shards fill in turns.

Every shard prefers the slots of a prime-sized table in an order of its own, a permutation given
by an offset and a step.  Shards take turns claiming their most preferred free slot, so
they differ by one slot at most, and a shard added or lost moves few documents.  A document's
slot is a hash; the table, whose size is a parameter, is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, far more than there are shards.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that holds each slot; its place in ``shards``, which are distinct names."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be a prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one and at most one per slot")
    offset = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    table = [-1] * slots
    at = list(offset)
    for claim in range(slots):
        s = claim % len(shards)
        while table[at[s]] >= 0:
            at[s] = (at[s] + step[s]) % slots
        table[at[s]] = s
    return np.array(table, np.int32)


def assign_shards(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (a name) in place of any columns of these names.

    The slot is the hash of ``key`` as a long, modulo ``slots``; rows with a NULL key share one slot, as
    do rows that repeat a key.  The order of rows does not matter.  Every row is kept; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    names = pa.array(shards).take(pa.array(fill_table(shards, slots)))
    table = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(slots, dtype=np.int64)), "shard": names}))
    rows = docs.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(slots)))
    return rows.join(F.broadcast(table), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")
