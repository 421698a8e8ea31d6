"""Which channels deviate together: counts of co-located cells from bitmaps of bands.

A field is cut into bands of consecutive cells.  Of every band of every channel two things travel:
one bit per cell, whether the symbol lies far from the channel's mode, and a code per cell, its
symbol and spatial context.  Where the bands of one sample meet, the cells with a given code
are one mask, and AND and a population count with another channel's bits say how many of them
have a deviating neighbour there.  No cell is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import field_sums, lists, rows_of

#: Cells of a band, a multiple of 64.
BAND = 1 << 14
#: Spatial contexts of a cell: how many of the upper and left neighbour deviate.
CONTEXTS = 3


def band_rows(fields: DataFrame, side: DataFrame, band: int = BAND) -> DataFrame:
    """One row per (sample, channel, band): ``flags`` (bits) and ``codes`` (little-endian 32-bit, -1 for a missing cell).

    ``side`` has a row per channel ``c``: ``mode``, ``th``, ``lo`` and the channel's number ``k``.
    """
    sample = fields.schema["sample"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            flat, ends, there = rows_of(batch.column("values"))
            picked, at, flags, codes = [], [], [], []
            scalars = [batch.column(c).to_numpy() for c in ("w", "mode", "th", "lo")]
            for row, (end, start, ok, w, mode, th, lo) in enumerate(zip(ends, [0, *ends[:-1]], there, *scalars)):
                if not ok or end == start:
                    continue
                x = flat[start:end].reshape(-1, w)
                far = np.abs(x - mode) > th
                ctx = np.zeros(x.shape, np.int32)
                ctx[1:] += far[:-1]
                ctx[:, 1:] += far[:, :-1]
                code = np.where(np.isnan(x), -1, np.nan_to_num(x - lo) * CONTEXTS + ctx).astype("<i4").ravel()
                far = far.ravel()
                for first in range(0, len(code), band):
                    picked.append(row)
                    at.append(first // band)
                    flags.append(np.packbits(far[first : first + band], bitorder="little").tobytes())
                    codes.append(code[first : first + band].tobytes())
            kept = [batch.column(c).take(pa.array(picked, pa.int64())) for c in ("sample", "k")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(at, pa.int32()), pa.array(flags, pa.binary()), pa.array(codes, pa.binary())],
                ["sample", "k", "band", "flags", "codes"],
            )

    rows = fields.select("sample", "c", "w", "values").join(side.select("c", "mode", "th", "lo", "k"), "c")
    rows = rows.select("sample", F.col("k").cast("int"), F.col("w").cast("int"), F.col("mode").cast("double"),
                       F.col("th").cast("double"), F.col("lo").cast("double"), "values")
    return rows.mapInArrow(cut, f"sample {sample}, k int, band int, flags binary, codes binary")


class PairCounts:
    """Counts per (channel, code): cells, and how many of them deviate in every channel.

    Bands of samples with the same channels are put end to end, so that small fields are counted
    together; what is held is one band's bitmaps and the counts themselves.
    """

    def __init__(self, channels: int, band: int):
        self.channels, self.band = channels, band
        self.counts: dict[tuple[int, int], np.ndarray] = {}
        self.waiting: list[dict[int, tuple[bytes, bytes]]] = []
        self.cells = 0

    def add(self, bands: dict[int, tuple[bytes, bytes]]) -> None:
        """The bands of one sample, by channel: flags and codes."""
        if self.waiting and self.waiting[0].keys() != bands.keys():
            self.count()
        self.waiting.append(bands)
        self.cells += max(len(codes) for _, codes in bands.values()) // 4
        if self.cells >= self.band:
            self.count()

    def count(self) -> None:
        waiting, self.waiting, self.cells = self.waiting, [], 0
        if not waiting:
            return
        numbers = sorted(waiting[0])
        sizes = [max(len(b[k][1]) for k in numbers) // 4 for b in waiting]
        flags, codes = [], []
        for k in numbers:
            bits = [np.unpackbits(np.frombuffer(b[k][0], np.uint8), count=n, bitorder="little") for b, n in zip(waiting, sizes)]
            flags.append(_words(np.concatenate(bits)))
            codes.append(np.concatenate([np.frombuffer(b[k][1], "<i4") for b in waiting]))
        if len({len(c) for c in codes}) > 1:
            raise ValueError("fields of one sample differ in size")
        planes = np.stack(flags)
        for k, code in zip(numbers, codes):
            for found in np.unique(code[code >= 0]).tolist():
                mask = _words(code == found)
                hits = np.bitwise_count(planes & mask).sum(axis=1, dtype=np.int64)
                total = self.counts.setdefault((k, found), np.zeros(self.channels + 1, np.int64))
                total[0] += int(np.bitwise_count(mask).sum())
                total[1 + np.array(numbers)] += hits


def _words(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<u8")


def pair_counts(bands: DataFrame, channels: int, band: int = BAND) -> DataFrame:
    """From :func:`band_rows`: ``k``, ``sym_at`` (symbol minus the channel's lowest), ``ctx``, ``n`` cells and ``hits``, an
    array with the number of them that deviate in each channel.

    One shuffle of bands by sample; after that only counts travel.  A channel that a sample lacks does
    not deviate there.
    """

    def samples(batches: Iterator[pa.RecordBatch]):
        key, held = None, {}
        for batch in batches:
            for sample, at, k, flags, codes in zip(*(batch.column(c).to_pylist() for c in ("sample", "band", "k", "flags", "codes"))):
                if held and (sample, at) != key:
                    yield held
                    held = {}
                if k in held:
                    raise ValueError("a field is repeated")
                key = (sample, at)
                held[k] = (flags, codes)
        if held:
            yield held

    def count(batches):
        found = PairCounts(channels, band)
        for bands_of_one in samples(batches):
            found.add(bands_of_one)
        found.count()
        keys = list(found.counts)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            columns = [pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, lists([found.counts[k] for k in part])], ["k", "code", "hits"])

    rows = bands.repartition("sample", "band").sortWithinPartitions("sample", "band")
    rows = field_sums(rows.mapInArrow(count, "k int, code int, hits array<long>"), ["k", "code"], "hits")
    return rows.select(
        "k",
        F.floor(F.col("code") / CONTEXTS).cast("int").alias("sym_at"),
        (F.col("code") % CONTEXTS).alias("ctx"),
        F.element_at("hits", 1).cast("long").alias("n"),
        F.slice("hits", 2, channels).cast("array<long>").alias("hits"),
    )
