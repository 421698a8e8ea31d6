"""Small helpers for functions that Spark runs over Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A-Z to a-z and nothing else, whatever the encoding of other characters.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, NULL as None."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text; NULL has none.

    ``bytes.split`` cuts at exactly these six characters.
    """
    return text.split() if text else []


def once_per_worker(key, make: Callable):
    """An object made once per Python worker process and kept for its later tasks."""
    store = sys.modules.setdefault("_fieldloom_worker", types.ModuleType("_fieldloom_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` so that no run of equal keys is cut.

    A table is handed on as soon as it has ``least`` rows and a run has ended, so at most
    that many rows and one run are held.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held)
        cut = int(run_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The positions at which a new run of equal keys starts."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
