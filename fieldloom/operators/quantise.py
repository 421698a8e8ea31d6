"""Q01-Q06: quantisation as column expressions.

Rounding is half to even everywhere here (``rint``); adding 0.0 removes negative zero.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, hash_number, log_table, present
from ..sizing import as_column

# Bounds and size of the scale table, and the smallest scale used.
SCALE_MIN, SCALE_MAX, SCALE_COUNT = 0.11, 256.0, 64
SCALE_BOUND = 0.11


def quantize_dequantize(y: Column, mean=0.0) -> Column:
    """Q01: round the residual to an integer and add the mean back."""
    m = as_column(mean)
    return F.rint(y - m) + m + F.lit(0.0)


def quantize_symbols(y: Column, mean=0.0) -> Column:
    """Q02: the rounded residual as an integer symbol; NULL if it is missing or no integer can hold it."""
    r = F.rint(present(y) - as_column(mean))
    return F.when(fits_symbol(y, mean), r).cast("int")


def fits_symbol(y: Column, mean=0.0) -> Column:
    """Whether Q02 has a symbol for a value that is there; NULL for a missing one."""
    return F.rint(present(y) - as_column(mean)).between(-(2**31), 2**31 - 1)


def dequantize(sym: Column, mean=0.0) -> Column:
    """Q03: symbol plus mean."""
    return sym.cast("double") + as_column(mean)


def hash_uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends only on the seed and the row's key."""
    return hash_number(seed, *keys).cast("double") / float(2**52)


def quantize_noise(y: Column, seed: int, keys: Sequence[str] = ()) -> Column:
    """Q04: add uniform noise in [-0.5, 0.5).

    With ``keys`` the noise is a function of the row's key, so a re-run task draws the
    same numbers; without, it is Spark's seeded ``rand``.
    """
    u = hash_uniform(seed, *keys) if keys else F.rand(seed)
    return y + u - 0.5


def scale_index(scale: Column) -> Column:
    """Q05: index into the log-spaced scale table.

    The index is the number of table entries, all but the last, below the bounded
    scale.  The logarithm gives the position up to one; the three entries around it
    settle the exact comparison, so the cost does not grow with the table.  A missing scale
    has no index.
    """
    table = log_table(SCALE_MIN, SCALE_MAX, SCALE_COUNT)[:-1]
    last = len(table) - 1
    step = (math.log(SCALE_MAX) - math.log(SCALE_MIN)) / (SCALE_COUNT - 1)
    s = clamp(present(scale), SCALE_BOUND)
    near = F.floor((F.ln(s) - math.log(SCALE_MIN)) / step)
    mid = clamp(near, 1, last - 1).cast("int")
    entries = F.array(*[F.lit(t) for t in table])
    below = [(F.get(entries, mid + d) < s).cast("int") for d in (-1, 0, 1)]
    return (mid - 1 + below[0] + below[1] + below[2]).cast("int")


def center_latent(cells: DataFrame, means: DataFrame, channel: str = "c", value: str = "y") -> DataFrame:
    """Q06: rounded offset from the channel mean as a 16-bit integer.

    Values that do not fit are NULL and flagged in ``overflow``; a value or channel mean that is
    missing gives NULL in both.
    """
    side = means.select(channel, F.col("mean").alias("_m"))
    r = F.rint(present(value) - F.col("_m"))
    fits = r.between(-32768, 32767)
    return (
        cells.join(side, channel, "left")
        .withColumns({"centered": F.when(fits, r).cast("short"), "overflow": ~fits})
        .drop("_m")
    )
