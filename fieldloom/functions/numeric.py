"""Scalar column expressions: erfc, decibels, log-spaced tables, size units."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# W. J. Cody, "Rational Chebyshev approximations for the error
# function", Math. Comp. 23 (1969).  Coefficients of three rational functions,
# highest order last except for the trailing leading coefficient of the numerator.
ERF_SMALL_NUM = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02,
                 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_SMALL_DEN = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03,
                 2.84423683343917062e03)
ERFC_MID_NUM = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01,
                2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03,
                2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_MID_DEN = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
                1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
                3.43936767414372164e03, 1.23033935480374942e03)
ERFC_TAIL_NUM = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
                 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
ERFC_TAIL_DEN = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
                 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: Column, num: tuple, den: tuple) -> Column:
    """num[-1]*x^n + num[0]*x^(n-1) + ... over x^n + den[0]*x^(n-1) + ..., by Horner."""
    top = reduce(lambda acc, c: (acc * x) + c, num[:-1], F.lit(num[-1]))
    bottom = reduce(lambda acc, c: (acc * x) + c, den, F.lit(1.0))
    return top / bottom


def with_erfc(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add complementary error functions: name -> erfc(expression).

    Relative error is below 1e-12 over the range where the result is a normal double.
    Spark has no erf of its own.

    The argument and its powers become columns before the polynomials use them.  Inside
    one big expression each of their dozens of uses would evaluate them again.
    """
    step = {f"_{n}_x": x for n, x in columns.items()}
    powers = {}
    for n in columns:
        x = F.col(f"_{n}_x")
        powers |= {f"_{n}_a": F.abs(x), f"_{n}_q": x * x, f"_{n}_i": F.lit(1.0) / F.greatest(x * x, F.lit(1.0))}
    parts = df.withColumns(step).withColumns(powers)
    done = parts.withColumns(
        {n: _erfc(*[F.col(f"_{n}_{k}") for k in "xaqi"]) for n in columns}
    )
    return done.drop(*step, *powers)


def _erfc(x: Column, a: Column, sq: Column, inv: Column) -> Column:
    """erfc from the argument, its absolute value, its square and 1/square."""
    small = F.lit(1.0) - x * _ratio(sq, ERF_SMALL_NUM, ERF_SMALL_DEN)
    mid = _ratio(a, ERFC_MID_NUM, ERFC_MID_DEN)
    tail = (F.lit(1.0 / math.sqrt(math.pi)) - inv * _ratio(inv, ERFC_TAIL_NUM, ERFC_TAIL_DEN)) / a
    positive = F.exp(-sq) * F.when(a <= 4.0, mid).otherwise(tail)
    # 2 - p for negative arguments, p otherwise.
    outer = F.when(x < 0, F.lit(2.0)).otherwise(F.lit(0.0)) + F.signum(x) * positive
    return F.when(a <= 0.46875, small).otherwise(outer)


def erfc_array(x: np.ndarray) -> np.ndarray:
    """:func:`with_erfc` for arrays; NaN stays NaN."""
    ratio = lambda v, num, den: reduce(lambda acc, c: acc * v + c, num[:-1], num[-1]) / reduce(lambda acc, c: acc * v + c, den, 1.0)
    a = np.abs(x)
    out = np.empty_like(x)
    small, far = a <= 0.46875, a > 4.0
    middle = ~(small | far)
    out[small] = 1.0 - x[small] * ratio(x[small] * x[small], ERF_SMALL_NUM, ERF_SMALL_DEN)
    v = a[middle]
    out[middle] = np.exp(-v * v) * ratio(v, ERFC_MID_NUM, ERFC_MID_DEN)
    v = a[far]
    inv = 1.0 / (v * v)
    out[far] = np.exp(-v * v) * (1.0 / math.sqrt(math.pi) - inv * ratio(inv, ERFC_TAIL_NUM, ERFC_TAIL_DEN)) / v
    return np.where((x < 0) & ~small, 2.0 - out, out)


def present(x: Column | str) -> Column:
    """The value, or NULL where it is NaN: missing cells are NULL from here on."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x), x)


def clamp(x: Column, low=None, high=None) -> Column:
    """Limit a value on one or both sides; NULL stays NULL.

    ``greatest`` and ``least`` alone skip NULL and would turn a missing value into a bound.
    """
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def hash_number(seed: int, *keys: str) -> Column:
    """A whole number in [0, 2^52) that depends only on the seed and the row's key."""
    text = F.concat_ws(",", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def psnr_from_mse(mse: Column, peak: float) -> Column:
    """``20 log10(peak) - 10 log10(mse)``; a perfect match gives infinity."""
    value = F.lit(20.0 * math.log10(peak)) - F.lit(10.0) * F.log10(mse)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(value)


def ratio_to_db(x: Column) -> Column:
    """Similarity in [0, 1] -> decibels, ``-10 log10(1 - x)``; 1 gives infinity."""
    return F.when(x == 1, F.lit(float("inf"))).otherwise(F.lit(-10.0) * F.log10(F.lit(1.0) - x))


def log_table(low: float, high: float, count: int) -> list[float]:
    """``count`` values evenly spaced in the logarithm, ends included."""
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * k / (count - 1)) for k in range(count)]


def human_size(n: Column) -> Column:
    """bytes with a unit letter and one decimal, rounded half up, e.g. ``1.5K``."""
    # The unit letters, each 1024 times the one before.
    units = ("", "K", "M", "G", "T", "P")
    n = n.cast("double")
    out = None
    for power, unit in enumerate(units):
        tenths = F.floor(n / float(1024**power) * 10 + 0.5)
        text = F.when(tenths % 10 == 0, (tenths / 10).cast("long").cast("string")).otherwise(
            F.format_string("%.1f", tenths / 10)
        )
        text = F.concat(text, F.lit(unit))
        hit = n < float(1024 ** (power + 1))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def size_in(n: Column, unit: str) -> Column:
    """Bytes as a plain number of GB, MB or KB (1024-based)."""
    powers = {"KB": 1, "MB": 2, "GB": 3}
    if unit not in powers:
        raise ValueError(f"unknown unit {unit!r}")
    return n.cast("double") / float(1024 ** powers[unit])
