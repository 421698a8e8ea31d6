"""Colour space conversion on wide columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ITU-R BT.709 luma weights for red, green and blue.
KR, KG, KB = 0.2126, 0.7152, 0.0722


def rgb_to_ycbcr(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Add ``y``, ``cb``, ``cr``; chroma is centred on 0.5."""
    return df.withColumn("y", KR * F.col(r) + KG * F.col(g) + KB * F.col(b)).withColumns(
        {
            "cb": 0.5 * (F.col(b) - F.col("y")) / (1 - KB) + 0.5,
            "cr": 0.5 * (F.col(r) - F.col("y")) / (1 - KR) + 0.5,
        }
    )


def ycbcr_to_rgb(df: DataFrame, y: str = "y", cb: str = "cb", cr: str = "cr") -> DataFrame:
    """Add ``r``, ``g``, ``b``; exact inverse of :func:`rgb_to_ycbcr`."""
    return df.withColumns(
        {
            "r": F.col(y) + (2 - 2 * KR) * (F.col(cr) - 0.5),
            "b": F.col(y) + (2 - 2 * KB) * (F.col(cb) - 0.5),
        }
    ).withColumn("g", (F.col(y) - KR * F.col("r") - KB * F.col("b")) / KG)
