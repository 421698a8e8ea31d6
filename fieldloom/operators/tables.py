"""Integer code tables of whole groups: counts of symbols in, edges or bits out.

The counts of a group travel as one record, two arrays that the symbol range bounds.  An Arrow
function turns them into a table in a few array steps, so a group costs one shuffle: no dense
rows, joins or windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of tables handed on together.
ROWS = 1 << 17


def edges(counts: np.ndarray, whole: int, total: int) -> np.ndarray:
    """The edges of a table: one step of at least 1 per symbol, strictly increasing up to ``total``.

    Shares are rounded half away from zero.  The last edge is fixed; where the steps before
    it leave no room, edges are pulled down from the top.
    """
    share = counts * ((total - 1) / whole) if whole else np.zeros(len(counts))
    down = np.floor(share)
    width = np.maximum((down + (share - down >= 0.5)).astype(np.int64), 1)
    raw = np.concatenate([[0], np.cumsum(width)])
    raw[-1] = total
    k = np.arange(len(raw))
    out = np.minimum.accumulate((raw - k)[::-1])[::-1] + k
    out[0] = 0
    return out


def _counts(hist: DataFrame, keys: Sequence[str], support: DataFrame, groups: DataFrame | None, channel: Sequence[str],
            sym: str) -> DataFrame:
    """One row per group: ``keys``, ``lo``, ``hi``, and the pairs of symbols and counts in ``_h``."""
    rows = hist.groupBy(*keys).agg(F.collect_list(F.struct(F.col(sym).cast("long").alias("s"), F.col("n").cast("long").alias("n"))).alias("_h"))
    if groups is not None:
        rows = groups.join(rows, list(keys), "left")
    return rows.join(support.select(*channel, "lo", "hi"), list(channel)).select(
        *keys, F.col("lo").cast("long"), F.col("hi").cast("long"), "_h"
    )


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per row: ``lo``, ``hi``, the symbols that are there and their counts, missing symbols as the last count."""
    pairs = batch.column("_h")
    flat = pairs.flatten()
    sym = flat.field("s")
    there = sym.is_valid().to_numpy(zero_copy_only=False)
    sym, n = sym.fill_null(0).to_numpy(), flat.field("n").to_numpy()
    end = np.cumsum(pairs.value_lengths().fill_null(0).to_numpy())
    for lo, hi, a, b in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), [0, *end[:-1]], end):
        ok = there[a:b]
        yield lo, hi, sym[a:b][ok], np.append(n[a:b][ok], n[a:b][~ok].sum())


def _table(lo: int, hi: int, sym: np.ndarray, n: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a group's table, and which of its symbols have a place there."""
    inside = (sym >= lo) & (sym < hi)
    counts = np.zeros(hi - lo, np.int64)
    counts[sym[inside] - lo] = n[:-1][inside]
    return edges(counts, int(n[:-1].sum()), total), inside


def _with_keys(rows: DataFrame, keys: Sequence[str], more: list[T.StructField], each: Callable) -> DataFrame:
    """Run ``each`` on every group; its arrays become rows behind the group's keys."""
    schema = T.StructType([*(rows.schema[k] for k in keys), *more])
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    kinds = [kinds[f.dataType.simpleString()] for f in more]
    names = schema.names

    def made(batches):
        for batch in batches:
            held, at, size = [], [], 0
            for row, group in enumerate(_groups(batch)):
                held.append(each(*group))
                at.append(np.full(len(held[-1][0]), row))
                size += len(at[-1])
                if size >= ROWS:
                    yield together(batch, held, at)
                    held, at, size = [], [], 0
            if held:
                yield together(batch, held, at)

    def together(batch, held, at):
        picked = pa.array(np.concatenate(at))
        columns = [batch.column(k).take(picked) for k in keys]
        for which, kind in enumerate(kinds):
            parts = [h[which] for h in held]
            columns.append(pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p, kind) for p in parts]))
        return pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(made, schema)


def cdf_rows(hist: DataFrame, keys: Sequence[str], support: DataFrame, groups: DataFrame | None,
             channel: Sequence[str], sym: str, total: int) -> DataFrame:
    """Per group and edge ``k``: the symbol that starts there, ``cproba`` and ``step`` (NULL on the closing edge)."""

    def each(lo, hi, found, n):
        edge, _ = _table(lo, hi, found, n, total)
        k = np.arange(len(edge), dtype=np.int32)
        step = pa.array(np.append(np.diff(edge), 0), pa.int64(), mask=k == hi - lo)
        return k, (k + lo).astype(np.int32), edge, step

    more = [T.StructField("k", T.IntegerType()), T.StructField(sym, T.IntegerType()), T.StructField("cproba", T.LongType()), T.StructField("step", T.LongType())]
    return _with_keys(_counts(hist, keys, support, groups, channel, sym), keys, more, each)


def coded_bits(hist: DataFrame, keys: Sequence[str], support: DataFrame, channel: Sequence[str], sym: str,
               precision: int) -> DataFrame:
    """What each group's symbols cost under the table of their own counts: ``_bits`` in all, ``n`` symbols
    coded and ``n_unpriced`` outside the table or missing."""

    def each(lo, hi, found, n):
        edge, inside = _table(lo, hi, found, n, 1 << precision)
        step = np.diff(edge)[found[inside] - lo]
        coded = n[:-1][inside]
        return [float((coded * (precision - np.log2(step))).sum())], [int(coded.sum())], [int(n.sum() - coded.sum())]

    more = [T.StructField("_bits", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("n_unpriced", T.LongType())]
    return _with_keys(_counts(hist, keys, support, None, channel, sym), keys, more, each)
