"""Work on whole packed fields: array arithmetic per batch, element-wise aggregates per key.

A field travels as one record whatever its size.  Missing cells (NULL or NaN) are NaN inside and
NULL outside.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose sums one task holds at a time before it hands the oldest on.
HELD = 16
#: Bytes of arrays handed on together.
BYTES = 1 << 23


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a list column end to end, where each list ends, and which lists are there."""
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes), there


def matrix(column: pa.Array, cells: int) -> np.ndarray:
    """A list column as one row of ``cells`` numbers per field; any other length is an error, a NULL field is all missing."""
    flat, ends, there = rows_of(column)
    sizes = np.diff(ends, prepend=0)
    if (sizes[there] != cells).any():
        raise ValueError(f"every field must have {cells} cells")
    if there.all():
        return flat.reshape(-1, cells)
    out = np.full((len(sizes), cells), np.nan)
    out[there] = flat.reshape(-1, cells)
    return out


def lists(arrays: list[np.ndarray], missing: list[np.ndarray] | None = None) -> pa.ListArray:
    """A list column of arrays; elements flagged in ``missing`` become NULL."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.concatenate(missing) if missing else None))


def _totals(fields: DataFrame, keys: Sequence[str], values: str, means: bool) -> DataFrame:
    keys = list(keys)
    key_schema = [fields.schema[k] for k in keys]
    partial = T.StructType([*key_schema, T.StructField("_s", T.ArrayType(T.DoubleType())), T.StructField("_n", T.ArrayType(T.LongType()))])
    names = [*keys, "_s", "_n"]

    def handed_on(groups: Iterator[tuple], kinds: list, finish) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in groups:
            held.append(group)
            size += group[1].nbytes
            if size >= BYTES:
                yield finish(held, kinds)
                held, size = [], 0
        if held:
            yield finish(held, kinds)

    def columns(held: list, kinds: list) -> list[pa.Array]:
        return [pa.array([key[k] for key, _, _ in held], kind) for k, kind in enumerate(kinds)]

    def sums(held, kinds):
        return pa.RecordBatch.from_arrays([*columns(held, kinds), lists([s for _, s, _ in held]), lists([n for _, _, n in held])], names)

    def averages(held, kinds):
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = lists([s / n for _, s, n in held], [n == 0 for _, _, n in held])
        return pa.RecordBatch.from_arrays([*columns(held, kinds), mean], [*keys, values])

    def key_rows(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows

    def same_size(a: np.ndarray, b: np.ndarray) -> None:
        if len(a) != len(b):
            raise ValueError("fields of one group differ in size")

    def pre_sum(batches):
        kinds: list = []

        def groups():
            held: OrderedDict = OrderedDict()
            for batch in batches:
                kinds[:] = [batch.column(k).type for k in keys]
                flat, ends, there = rows_of(batch.column(values))
                for key, end, start, ok in zip(key_rows(batch), ends, [0, *ends[:-1]], there):
                    if not ok:
                        continue
                    x = flat[start:end]
                    present = ~np.isnan(x)
                    if key in held:
                        s, n = held[key]
                        same_size(s, x)
                        s += np.where(present, x, 0.0)
                        n += present
                        held.move_to_end(key)
                        continue
                    held[key] = (np.where(present, x, 0.0), present.astype(np.int64))
                    if len(held) > HELD:
                        key, (s, n) = held.popitem(last=False)
                        yield key, s, n
            for key, (s, n) in held.items():
                yield key, s, n

        yield from handed_on(groups(), kinds, sums)

    def merge(batches):
        kinds: list = []

        def groups():
            key = s = n = None
            for batch in batches:
                kinds[:] = [batch.column(k).type for k in keys]
                flat, ends, _ = rows_of(batch.column("_s"))
                counts = batch.column("_n").flatten().to_numpy()
                for this, end, start in zip(key_rows(batch), ends, [0, *ends[:-1]]):
                    if s is not None and this == key:
                        same_size(s, flat[start:end])
                        s += flat[start:end]
                        n += counts[start:end]
                        continue
                    if s is not None:
                        yield key, s, n
                    key, s, n = this, flat[start:end].copy(), counts[start:end].copy()
            if s is not None:
                yield key, s, n

        yield from handed_on(groups(), kinds, averages if means else sums)

    out = T.StructType([*key_schema, T.StructField(values, T.ArrayType(T.DoubleType()))]) if means else partial
    parts = fields.select(*keys, values).mapInArrow(pre_sum, partial)
    parts = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)
    return parts.mapInArrow(merge, out)


def field_means(fields: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    """Element-wise mean of the packed fields of each key, over the cells that are present.

    One row per key: ``keys`` and ``values``, NULL where no field has the cell.  A task first adds up
    what it reads (for a bounded number of keys at a time), so a field is at most one shuffle
    record; sorted partial sums are then folded as a stream, so a key is never held whole.
    NULL fields do not count; fields of different sizes under one key are an error.
    """
    return _totals(fields, keys, values, means=True)


def field_sums(fields: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    """As :func:`field_means`, but ``values`` are element-wise sums, 0 where nothing is present."""
    rows = _totals(fields, keys, values, means=False)
    return rows.select(*keys, F.col("_s").alias(values))


def groups_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, one key at a time, from batches sorted by ``keys``."""
    key, held = None, []
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for at, this in enumerate(rows):
            if this == key:
                continue
            if at > start:
                held.append(batch.slice(start, at - start))
            if held:
                yield key, pa.Table.from_batches(held).combine_chunks()
            key, held, start = this, [], at
        if len(rows) > start:
            held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()
