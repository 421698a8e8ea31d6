"""The bitstream container.

Layout, all integers unsigned 32-bit big-endian: height and width of the hyper-latent,
the number of strings, then per string its length and its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layout import div, let

HEADER_BYTES = 12


def _read_uint32(content: Column, offset: Column) -> Column:
    return F.conv(F.hex(F.substring(content, offset + 1, F.lit(4))), 16, 10).cast("long")


def _uint32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def container_catalog(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Header fields, the offset and length of every string, and the total bits.

    Parsed with column expressions.  ``truncated`` marks a blob that ends before what
    its header and lengths announce; the strings found up to there are kept.  A header
    that announces more strings than could fit costs no more than the blob's size.
    """
    empty = F.array().cast("array<struct<offset:bigint,length:bigint>>")
    none = F.lit(None).cast("long")

    def parse(c: Column) -> Column:
        size = F.octet_length(c).cast("long")
        has_header = size >= HEADER_BYTES
        word = lambda at: F.when(has_header, _read_uint32(c, F.lit(at))).otherwise(none)

        def step(acc, _):
            length = _read_uint32(c, acc["pos"].cast("int"))
            begin = acc["pos"] + 4
            fits = F.coalesce(acc["ok"] & (begin <= size) & (begin + length <= size), F.lit(False))
            found = F.struct(begin.alias("offset"), length.alias("length"))
            return F.struct(
                F.when(fits, begin + length).otherwise(acc["pos"]).alias("pos"),
                fits.alias("ok"),
                F.when(fits, F.concat(acc["parts"], F.array(found))).otherwise(acc["parts"]).alias("parts"),
            )

        start = F.struct(F.lit(HEADER_BYTES).cast("long").alias("pos"), F.lit(True).alias("ok"), empty.alias("parts"))
        most = F.least(word(8), div(size - HEADER_BYTES, 4))
        todo = F.when(most > 0, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            word(0).alias("z_h"), word(4).alias("z_w"), word(8).alias("n"), F.aggregate(todo, start, step).alias("f")
        )

    # The blob may itself be a derived column; it is bound once, not rebuilt per string.
    rows = blobs.withColumn("_p", let(F.col(content), parse))
    parts = F.col("_p.f.parts")
    complete = F.col("_p.f.ok") & (F.size(parts) == F.col("_p.n"))
    keep = [x for x in blobs.columns if x != content]
    return rows.select(
        *keep,
        F.col("_p.z_h").alias("z_h"),
        F.col("_p.z_w").alias("z_w"),
        F.col("_p.n").alias("n_strings"),
        parts.alias("parts"),
        (F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["length"]) * 8).alias("total_bits"),
        (~F.coalesce(complete, F.lit(False))).alias("truncated"),
    )


def container_pack(rows: DataFrame, strings: str = "strings", z_h: str = "z_h", z_w: str = "z_w") -> DataFrame:
    """Header and length-prefixed strings as one binary column ``content``.

    The strings of a container are an array in one row, as the encoder returns them, so
    nothing is grouped or shuffled.
    """
    prefixed = F.transform(strings, lambda s: F.concat(_uint32(F.octet_length(s)), s))
    body = F.aggregate(prefixed, F.unhex(F.lit("")), lambda acc, s: F.concat(acc, s))
    header = F.concat(_uint32(F.col(z_h)), _uint32(F.col(z_w)), _uint32(F.size(strings)))
    return rows.withColumn("content", F.concat(header, body)).drop(strings)
