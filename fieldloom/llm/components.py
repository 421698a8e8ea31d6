"""Connected components of a link table, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: More rounds than any graph needs that fits a cluster: a round at least halves path lengths.
MAX_ROUNDS = 64


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Give every linked node the smallest node it can reach: columns ``node``, ``root``.

    ``links`` holds one row per undirected link between comparable, non-null nodes; repeated
    links and links of a node to itself do no harm.  Nodes without a link to another one are
    not returned.  Alternates large-star and small-star steps: each links a node's
    neighbours to the smallest of them, until every component is one star.  A step is a
    minimum per node (summed up map-side) and a join, so a node with very many neighbours is
    only a skewed join key, which Spark splits.  Each round is checkpointed.
    """
    spread = F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = checkpointed(links.where(F.col(a) != F.col(b)).select(spread.alias("e")).select("e.*").distinct())
    before = _mark(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(near.union(low.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digests of a link table, to see whether a round changed it."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first())
