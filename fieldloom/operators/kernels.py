"""Per-cell formulas and moments on packed fields, one array pass per Arrow batch.

The same results as the operators on cells, without a row per cell: fields come in and go out
packed, and statistics or bits leave a task as one row per key or field.  A formula runs over
``CELLS`` cells at a time whatever the size of a field, so its temporaries stay in the
processor's cache.  Missing cells (NULL or NaN) are NaN inside and NULL outside; a NULL field stays
NULL.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.numeric import erfc_array, log_table
from .likelihood import LIKELIHOOD_BOUND
from .packed import rows_of
from .quantise import SCALE_BOUND, SCALE_COUNT, SCALE_MAX, SCALE_MIN

#: Cells that a formula runs over at a time.
CELLS = 1 << 14
#: Keys whose moments one task holds at a time before it hands the oldest on.
HELD = 4096

Formula = Callable[..., np.ndarray]


class Aligned:
    """List columns of the same lengths, end to end, and columns of one number per list.

    A list is there where all of its row's lists are; lists of one row that differ in length are
    an error.  A number that is NULL is NaN.
    """

    def __init__(self, columns: Sequence[pa.Array]):
        packed = [rows_of(c) for c in columns if pa.types.is_list(c.type)]
        sizes = [np.diff(ends, prepend=0) for _, ends, _ in packed]
        self.there = np.logical_and.reduce([there for _, _, there in packed])
        if any((s[self.there] != sizes[0][self.there]).any() for s in sizes[1:]):
            raise ValueError("fields of one row differ in size")
        self.sizes = np.where(self.there, sizes[0], 0)
        self.ends = np.cumsum(self.sizes)
        self.arrays = [
            flat if (s == self.sizes).all() else flat[np.repeat(self.there, s)] for (flat, _, _), s in zip(packed, sizes)
        ]
        self.numbers = [
            c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns if not pa.types.is_list(c.type)
        ]

    def blocks(self):
        """Slices of the arrays with the numbers of their rows, repeated only where a slice spans several."""
        total = len(self.arrays[0])
        for start in range(0, total, CELLS):
            stop = min(total, start + CELLS)
            first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left")
            numbers = [x[first] for x in self.numbers]
            if first != last:
                times = np.diff(np.clip(self.ends[first : last + 1], start, stop), prepend=start)
                numbers = [np.repeat(x[first : last + 1], times) for x in self.numbers]
            yield slice(start, stop), [a[start:stop] for a in self.arrays], numbers

    def each(self, formula: Formula) -> np.ndarray:
        """``formula(*arrays, *numbers)`` of all cells."""
        out = np.empty(len(self.arrays[0]))
        with np.errstate(all="ignore"):
            for at, arrays, numbers in self.blocks():
                out[at] = formula(*arrays, *numbers)
        return out

    def lists(self, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        """The cells as lists again, NaN as NULL."""
        missing = np.isnan(values)
        if pa.types.is_integer(kind):
            values = np.where(missing, 0.0, values).astype(kind.to_pandas_dtype())
        offsets = pa.array(np.concatenate([[0], self.ends]).astype(np.int32), mask=np.append(~self.there, False))
        return pa.ListArray.from_arrays(offsets, pa.array(values, kind, mask=missing))


def per_cell(formula: Formula, *columns: Column | str, kind: str = "double") -> Column:
    """A packed column: ``formula`` of the cells of packed columns and of one number per row.

    ``formula`` gets packed columns first, in the order given, then the numbers, as arrays of
    doubles; NaN in its result is NULL.  ``kind`` is ``double`` or ``int``.
    """
    arrow = {"double": pa.float64(), "int": pa.int32()}[kind]

    @F.arrow_udf(f"array<{kind}>")
    def cells(*batch: pa.Array) -> pa.Array:
        lined = Aligned(batch)
        return lined.lists(lined.each(formula), arrow)

    return cells(*columns)


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _number(c: Column | str | float) -> Column:
    """A number of each row: a column, its name, or a constant."""
    if not isinstance(c, Column):
        c = F.col(c) if isinstance(c, str) else F.lit(float(c))
    return c.cast("double")


# --- statistics -------------------------------------------------------------------------


def field_stats(fields: DataFrame, keys: Sequence[str] = ("channel_idx",), values: str = "values") -> DataFrame:
    """N01 on packed fields: ``n``, ``mean``, population ``std`` and ``n_null`` per key.

    Every field gives its count, mean and squared deviations; a task merges those of a key
    (for a bounded number of keys at a time), so a row per task and key is shuffled, once.
    The rest is done around the key's mean, which does not cancel.  NULL fields do not count.
    """
    keys = list(keys)
    key_schema = [fields.schema[k] for k in keys]
    schema = T.StructType(
        [*key_schema, *(T.StructField(n, t) for n, t in (("_n", T.LongType()), ("_m", T.DoubleType()), ("_ss", T.DoubleType()), ("_null", T.LongType())))]
    )

    def moments(batches):
        held: OrderedDict = OrderedDict()
        kinds: list = []

        def batch_of(rows: list) -> pa.RecordBatch:
            key_columns = [pa.array([key[k] for key, _ in rows], kind) for k, kind in enumerate(kinds)]
            types = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
            merged = [pa.array([m[k] for _, m in rows], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*key_columns, *merged], schema.names)

        for batch in batches:
            kinds[:] = [batch.column(k).type for k in keys]
            flat, ends, there = rows_of(batch.column(values))
            sizes = np.diff(ends, prepend=0)
            known = ~np.isnan(flat)
            flat = np.where(known, flat, 0.0)
            bounds = np.concatenate([[0], ends])

            def sums(x):  # of every list; an empty one has nothing to add
                filled = np.flatnonzero(sizes)
                out = np.zeros(len(sizes))
                if len(filled):
                    out[filled] = np.add.reduceat(x, bounds[filled])
                return out

            n = sums(known.astype(np.float64))
            mean = np.divide(sums(flat), n, out=np.zeros(len(n)), where=n > 0)
            gap = np.where(known, flat - np.repeat(mean, sizes), 0.0)
            spread = sums(gap * gap)
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            for i in np.flatnonzero(there):
                key, own = names[i], (int(n[i]), float(mean[i]), float(spread[i]), int(sizes[i] - n[i]))
                held[key] = _merged(held[key], own) if key in held else own
                held.move_to_end(key)
            if len(held) > HELD:
                yield batch_of([held.popitem(last=False) for _ in range(len(held) - HELD)])
        if held:
            yield batch_of(list(held.items()))

    parts = fields.select(*keys, F.col(values).cast("array<double>").alias(values)).mapInArrow(moments, schema)
    over = W.partitionBy(*keys)
    centre = F.try_divide(F.sum(F.col("_n") * F.col("_m")).over(over), F.sum("_n").over(over))
    gap = F.col("_m") - F.col("_centre")
    return (
        parts.withColumn("_centre", centre)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n"),
            F.max("_centre").alias("mean"),
            F.sqrt(F.try_divide(F.sum(F.col("_ss") + F.col("_n") * gap * gap), F.sum("_n"))).alias("std"),
            F.sum("_null").alias("n_null"),
        )
    )


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean, squared deviations and missing cells of two sets together."""
    n = a[0] + b[0]
    if n == 0:
        return (0, 0.0, 0.0, a[3] + b[3])
    gap = b[1] - a[1]
    return (n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, a[3] + b[3])


def _with_stats(fields: DataFrame, stats: DataFrame, channel: str) -> DataFrame:
    side = stats.select(channel, F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return fields.join(side, channel, "left")


def standardize_fields(fields: DataFrame, stats: DataFrame, channel: str = "channel_idx", values: str = "values") -> DataFrame:
    """N04 on packed fields: ``(x - mean) / std``; std 0 gives NULL, and so does a channel without statistics."""
    scaled = per_cell(lambda x, m, s: (x - m) / np.where(s == 0, np.nan, s), _doubles(values), _number("_mean"), _number("_std"))
    return _with_stats(fields, stats, channel).withColumn(values, scaled).drop("_mean", "_std")


def destandardize_fields(fields: DataFrame, stats: DataFrame, channel: str = "channel_idx", values: str = "values") -> DataFrame:
    """N05 on packed fields: ``x * std + mean``; NULL for a channel without statistics."""
    restored = per_cell(lambda x, m, s: x * s + m, _doubles(values), _number("_mean"), _number("_std"))
    return _with_stats(fields, stats, channel).withColumn(values, restored).drop("_mean", "_std")


# --- quantisation -----------------------------------------------------------------------


def quantize_dequantize_fields(values: Column | str, mean: Column | str | float = 0.0) -> Column:
    """Q01 on a packed column: residuals rounded half to even, with the mean added back."""
    return per_cell(lambda y, m: np.rint(y - m) + m + 0.0, _doubles(values), _number(mean))


def quantize_symbols_fields(values: Column | str, mean: Column | str | float = 0.0) -> Column:
    """Q02 on a packed column: integer symbols; NULL if missing or if no 32-bit integer can hold one."""

    def symbols(y, m):
        r = np.rint(y - m)
        return np.where((r >= -(2.0**31)) & (r < 2.0**31), r, np.nan)

    return per_cell(symbols, _doubles(values), _number(mean), kind="int")


def dequantize_fields(symbols: Column | str, mean: Column | str | float = 0.0) -> Column:
    """Q03 on a packed column: symbol plus mean."""
    return per_cell(lambda s, m: s + m, _doubles(symbols), _number(mean))


def scale_index_fields(scales: Column | str) -> Column:
    """Q05 on a packed column: the number of table entries, all but the last, below the bounded scale."""
    table = np.array(log_table(SCALE_MIN, SCALE_MAX, SCALE_COUNT)[:-1])

    def index(s):
        return np.where(np.isnan(s), np.nan, np.searchsorted(table, np.maximum(s, SCALE_BOUND), "left"))

    return per_cell(index, _doubles(scales), kind="int")


# --- likelihood and rate ----------------------------------------------------------------


def _likelihood(y, s, m):
    width = np.maximum(s, SCALE_BOUND) * math.sqrt(2.0)
    v = np.abs(y - m)
    return np.maximum(0.5 * erfc_array((v - 0.5) / width) - 0.5 * erfc_array((v + 0.5) / width), LIKELIHOOD_BOUND)


def likelihood_fields(values: Column | str, scales: Column | str, mean: Column | str | float = 0.0) -> Column:
    """E14 on packed columns of latents and scales: the probability of every latent's unit-wide bin.

    Scales are at least 0.11, results at least 1e-9; a missing latent, scale or mean gives NULL.
    """
    return per_cell(_likelihood, _doubles(values), _doubles(scales), _number(mean))


def field_bits(values: Column | str, scales: Column | str, mean: Column | str | float = 0.0) -> Column:
    """E15 per packed field: a struct of ``bits``, the sum over its latents that have a likelihood
    (NULL if none has), and ``n_null``, the number of others.  Likelihoods are never stored."""

    @F.arrow_udf("struct<bits: double, n_null: long>")
    def price(y: pa.Array, s: pa.Array, m: pa.Array) -> pa.Array:
        lined = Aligned([y, s, m])
        spent = lined.each(lambda *cells: -np.log2(_likelihood(*cells)))
        known = ~np.isnan(spent)
        filled = np.flatnonzero(lined.sizes)
        starts = (lined.ends - lined.sizes)[filled]
        bits, n = np.zeros(len(lined.sizes)), np.zeros(len(lined.sizes), np.int64)
        if len(filled):
            bits[filled] = np.add.reduceat(np.where(known, spent, 0.0), starts)
            n[filled] = np.add.reduceat(known.astype(np.int64), starts)
        missing = pa.array(lined.sizes - n, pa.int64())
        return pa.StructArray.from_arrays([pa.array(bits, mask=n == 0), missing], names=["bits", "n_null"])

    return price(_doubles(values), _doubles(scales), _number(mean))


def bits_from_fields(fields: DataFrame, pixels: int, keys: Sequence[str] = ("sample",), values: str = "values",
                     scales: str = "scales", mean: Column | str | float = 0.0) -> DataFrame:
    """E15 on packed fields: ``bits``, ``n_null`` and ``bpp`` per key, from one row per field."""
    priced = fields.select(*keys, field_bits(values, scales, mean).alias("_p")).select(*keys, "_p.bits", "_p.n_null")
    total = priced.groupBy(*keys).agg(F.sum("bits").alias("bits"), F.sum("n_null").alias("n_null"))
    return total.withColumn("bpp", F.col("bits") / pixels)
