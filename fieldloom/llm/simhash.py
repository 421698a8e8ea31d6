"""Near-duplicates by SimHash, compared on vertical bit planes.

Two fingerprints that differ in at most two bits agree in three of five bit ranges, so every
such pair meets under one of the ten choices of three ranges.  Within the rows that share
a choice's bits, bit ``k`` of all fingerprints lies side by side in one plane.  A plane
shifted by ``d`` rows, XORed with itself, tells for 64 pairs per word whether they differ in
that bit; carry-save counters add up these planes for all pairs at distance ``d``, and words
are dropped as soon as all their pairs are beyond the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .batches import LOWER, run_starts, runs, utf8
from .components import connected_components

BITS = 64
#: Fingerprints compared in one go; a larger bucket is cut into pairs of parts this large.
PART = 16_384
#: Rows after which a batch of whole buckets is compared.
BATCH = 65_536
#: Planes between two looks at which words still hold a close pair.
CHECK_EVERY = 4
FULL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


# --- fingerprints -----------------------------------------------------------------------


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of one text: per bit, whether over half of the shingles' hashes set it."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(t) for t in zip(*(words[i:] for i in range(shingle)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text) and the SimHash ``fp`` of every document."""

    def compute(batches):
        for batch in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(compute, "doc_id long, text_key long, fp long")


# --- links ------------------------------------------------------------------------------


def close_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a``, ``b`` among distinct fingerprints ``fp`` at most ``radius`` bits apart.

    Not every close pair is listed, but any two fingerprints joined by a chain of close
    pairs stay joined by a chain of links: within a bucket, each fingerprint is linked to
    the smallest one that it reaches there.  A bucket with more than ``PART`` fingerprints is
    cut into parts by hash, and every pair of parts is compared in a group of its own.
    """
    choices = _choices(radius)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask, _ in choices])
    rows = fps.select("fp", F.posexplode(keys).alias("choice", "key"))
    crowded = rows.groupBy("choice", "key").count().where(F.col("count") > PART)
    crowded = crowded.select("choice", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    rows = rows.join(crowded, ["choice", "key"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")),
    )
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.select("choice", "key", "fp", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(meets)).alias("p"))
    group = ["choice", "key", "i", "j"]
    rows = rows.select("choice", "key", "p.i", "p.j", "fp").repartition(*group).sortWithinPartitions(*group)
    free = [bits for _, bits in choices]

    def compare(batches):
        for table in runs(batches, group, BATCH):
            a, b = _links_of_buckets(table, group, free, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _choices(radius: int) -> list[tuple[int, list[int]]]:
    """Masks that any two fingerprints within the radius agree under, for at least one of
    them, each with the bits left free."""
    ranges = np.array_split(np.arange(BITS), radius + 3)
    out = []
    for kept in combinations(ranges, len(ranges) - radius):
        held = {int(b) for r in kept for b in r}
        out.append((sum(1 << b for b in held), [b for b in range(BITS) if b not in held]))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _links_of_buckets(table: pa.Table, group: list[str], free: list[list[int]], radius: int):
    starts = run_starts(table, group)
    ends = np.append(starts[1:], table.num_rows)
    keep = ends - starts > 1
    fps = table.column("fp").to_numpy().view(np.uint64)
    choice = table.column("choice").to_numpy()[starts]
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(choice[keep]):
        chosen = keep & (choice == c)
        sizes = (ends - starts)[chosen]
        first = np.cumsum(sizes) - sizes
        rows = np.repeat(starts[chosen] - first, sizes) + np.arange(sizes.sum())
        mine = fps[rows]
        later = np.repeat(first + sizes, sizes) - np.arange(len(mine)) - 1  # rows after it in its bucket
        labels = np.arange(len(mine))
        for i, j in close_pairs(mine, later, free[c], radius):
            labels = merge_labels(labels, i, j)
        moved = np.flatnonzero(labels != np.arange(len(mine)))
        out_a.append(mine[moved].view(np.int64))
        out_b.append(mine[labels[moved]].view(np.int64))
    return np.concatenate(out_a), np.concatenate(out_b)


def close_pairs(fps: np.ndarray, later: np.ndarray, bits: list[int], radius: int):
    """Yield index arrays ``i < j`` of all pairs of one bucket within ``radius`` on ``bits``.

    ``later[i]`` is the number of rows that follow row ``i`` in its bucket.
    """
    words = -(-len(fps) // 64)
    reach = np.zeros(words * 64, np.int64)
    reach[: len(fps)] = later
    reach = reach.reshape(words, 64)
    widest = reach.max(axis=1, initial=0)
    spread = np.zeros((len(bits), (2 * words + 2) * 64), np.uint8)
    for row, bit in enumerate(bits):
        spread[row, : len(fps)] = (fps >> np.uint64(bit)) & np.uint64(1)
    planes = np.packbits(spread, axis=1, bitorder="little").view("<u8")
    del spread
    active = np.flatnonzero(widest > 0)
    for d in range(1, int(widest.max(initial=0)) + 1):
        active = active[widest[active] >= d]
        at = active
        ahead, shift = at + d // 64, np.uint64(d % 64)
        over = ~np.packbits(reach[at] >= d, axis=1, bitorder="little").view("<u8").ravel()
        counter = [np.zeros(len(at), np.uint64) for _ in range((radius + 1).bit_length())]
        for row in range(len(bits)):
            plane = planes[row]
            moved = plane[ahead] >> shift
            if shift:
                moved |= plane[ahead + 1] << (np.uint64(64) - shift)
            carry = plane[at] ^ moved
            beyond = FULL
            for k, digit in enumerate(counter):
                carry, counter[k] = digit & carry, digit ^ carry
                beyond = beyond & (counter[k] if (radius + 1) >> k & 1 else ~counter[k])
            over |= beyond
            if row % CHECK_EVERY == CHECK_EVERY - 1:
                left = over != FULL
                if not left.all():
                    at, ahead, over = at[left], ahead[left], over[left]
                    counter = [digit[left] for digit in counter]
                    if not len(at):
                        break
        left = np.flatnonzero(over != FULL)
        if len(left):
            bit = np.unpackbits((~over[left]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(bit)
            i = at[left][word] * 64 + lane
            yield i, i + d


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest reachable row) after linking rows ``i`` and ``j`` too."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(short := labels[labels], labels):
            labels = short


# --- the operator -----------------------------------------------------------------------


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most ``radius`` bits.

    Takes ``doc_id`` and ``text`` and looks at no other column.  Returns one row per input
    row: ``doc_id``, ``text_key`` (Spark's xxhash64 of the text), ``fp`` (the fingerprint as a
    signed long), ``group_fp`` (one fingerprint naming the group) and ``component_id``, the
    smallest non-null ``doc_id`` of the group.

    NULL, empty and blank texts have the fingerprint zero and are linked like any other.
    Rows with a NULL ``doc_id`` take part; ``component_id`` is NULL if a group has no other.
    Repeated rows stay and share a group.  An empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(close_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("group_fp", F.coalesce("root", "fp"))
    lows = named.groupBy("group_fp").agg(F.min("low").alias("component_id"))
    named = named.select("fp", "group_fp").join(lows, "group_fp")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "group_fp", "component_id")
