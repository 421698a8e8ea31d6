"""Windows, padding, tiling, regridding and blurring.

G01-G04, G06 and G09 move cells by index arithmetic alone.  G05, G07 and G08 combine
neighbouring cells and work inside packed rows.  None of them shuffles.

The three stencils are Arrow functions over batches of packed rows.  As lambdas over
Spark arrays they ran at 2 to 10 microseconds per cell on 721x1440 fields; as array
arithmetic they run 5 to 20 times faster.  Spark bounds a batch by bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sizing import as_column
from .layout import div, field_to_cells


def crop_origin(h: int, w: int, th: int, tw: int, seed: int, *keys: str) -> tuple[Column, Column]:
    """A window origin that depends on the sample key only, so that a sample's input and
    target get the same window."""
    if th > h or tw > w:
        raise ValueError("window larger than the field")
    k = [F.col(c) for c in keys]
    return (
        F.pmod(F.xxhash64(F.lit(seed), *k), F.lit(h - th + 1)).cast("int"),
        F.pmod(F.xxhash64(F.lit(seed + 1), *k), F.lit(w - tw + 1)).cast("int"),
    )


def crop(cells: DataFrame, y, x, th: int, tw: int) -> DataFrame:
    """Keep a ``th`` x ``tw`` window and re-base its indices.

    ``y`` and ``x`` are numbers or columns.
    """
    y, x = as_column(y), as_column(x)
    inside = (F.col("i") >= y) & (F.col("i") < y + th) & (F.col("j") >= x) & (F.col("j") < x + tw)
    return cells.where(inside).withColumns({"i": F.col("i") - y, "j": F.col("j") - x})


def _pad(fields: DataFrame, h: int, w: int, top: int, left: int, h2: int, w2: int) -> DataFrame:
    """Put every packed field into a larger frame of zeros, row by row inside its own array.

    Nothing is shuffled, and a missing cell stays missing without taking the border with it.
    """
    whole = F.when(F.size("values") == h * w, F.col("values")).otherwise(
        F.raise_error(F.lit(f"every field must have {h} x {w} cells"))
    )
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(h - 1)),
        lambda r: F.concat(zeros(left), F.slice(F.col("_v"), r * w + 1, F.lit(w)), zeros(w2 - w - left)),
    )
    framed = F.concat(zeros(top * w2), F.flatten(rows), zeros((h2 - h - top) * w2))
    out = fields.withColumn("_v", whole.cast("array<double>")).withColumn("values", framed).drop("_v")
    return out.withColumns({"h": F.lit(h2), "w": F.lit(w2)})


def padding(size: int, min_div: int) -> tuple[int, int, int]:
    """Padded size, amount in front and amount behind."""
    padded = (size + min_div - 1) // min_div * min_div
    front = (padded - size) // 2
    return padded, front, padded - size - front


def _frame(size: int, min_div: int | None, wanted: int | None) -> tuple[int, int]:
    """Padded size and amount in front, for a multiple or for a given size."""
    if (min_div is None) == (wanted is None):
        raise ValueError("give either a divisor or an output size")
    if wanted is None:
        return padding(size, min_div)[:2]
    if wanted < size:
        raise ValueError("the output must not be smaller than the field")
    return wanted, (wanted - size) // 2


def pad_center(fields: DataFrame, h: int, w: int, min_div: int | None = None, out_h: int | None = None,
               out_w: int | None = None) -> DataFrame:
    """Pad both sides of packed fields with zeros, to the next multiple of ``min_div`` or to
    ``out_h`` by ``out_w``; the smaller half goes in front."""
    h2, top = _frame(h, min_div, out_h)
    w2, left = _frame(w, min_div, out_w)
    return _pad(fields, h, w, top, left, h2, w2)


def unpad(cells: DataFrame, h: int, w: int, min_div: int | None = None, out_h: int | None = None,
          out_w: int | None = None) -> DataFrame:
    """Remove the padding of :func:`pad_center`, given the same sizes."""
    return crop(cells, _frame(h, min_div, out_h)[1], _frame(w, min_div, out_w)[1], h, w)


def tile(fields: DataFrame, keys: Sequence[str], h: int, w: int, wh: int, ww: int,
         value: str = "value") -> DataFrame:
    """Zero-pad packed fields at the bottom and right to whole tiles, then number the tiles.

    One row per cell; ``i`` and ``j`` are positions inside the tile.
    """
    h2, w2 = -(-h // wh) * wh, -(-w // ww) * ww
    across = w2 // ww
    padded = field_to_cells(_pad(fields, h, w, 0, 0, h2, w2), keys, value)
    number = F.floor(F.col("i") / wh) * across + F.floor(F.col("j") / ww)
    return padded.withColumn("tile", number.cast("int")).withColumns(
        {"i": F.col("i") % wh, "j": F.col("j") % ww}
    )


def untile(tiles: DataFrame, h: int, w: int, wh: int, ww: int) -> DataFrame:
    """G04 inverse: put tiles back and drop their padding."""
    across = -(-w // ww)
    placed = tiles.withColumns(
        {
            "i": (F.floor(F.col("tile") / across) * wh + F.col("i")).cast("int"),
            "j": (F.col("tile") % across * ww + F.col("j")).cast("int"),
        }
    )
    return placed.where((F.col("i") < h) & (F.col("j") < w)).drop("tile")


def _per_field(fields: DataFrame, h: int, w: int, h2: int, w2: int,
               fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Replace every ``h*w`` field by the ``h2*w2`` field that ``fn`` makes of it.

    ``fn`` maps (fields, h, w) to (fields, h2, w2) and is a weighted mean of cells.  Missing cells (NULL
    or NaN) take no part: the weights are scaled up over those that are present, and a cell is
    NULL only where none is.
    """

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        if batch.null_count or any(n != h * w for n in batch.value_lengths().unique().to_pylist()):
            raise ValueError(f"every field must have {h} x {w} cells")
        flat = batch.flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(-1, h, w)
        offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (h2 * w2))
        missing = np.isnan(x)
        holed = missing.any(axis=(1, 2))
        if not holed.any():
            return pa.ListArray.from_arrays(offsets, pa.array(fn(x).reshape(-1)))
        out = np.empty((len(x), h2, w2))
        weight = np.ones((len(x), h2, w2))
        out[~holed] = fn(x[~holed])
        weight[holed] = fn((~missing[holed]).astype(np.float64))
        some = weight > 0
        summed = fn(np.where(missing[holed], 0.0, x[holed]))
        out[holed] = np.divide(summed, weight[holed], out=np.zeros_like(summed), where=some[holed])
        return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1), mask=~some.reshape(-1)))

    values = run(F.col("values").cast("array<double>"))
    return fields.withColumns({"values": values, "h": F.lit(h2), "w": F.lit(w2)})


def downsample_avg(fields: DataFrame, h: int, w: int) -> DataFrame:
    """Mean of 2x2 blocks; an odd last row or column is dropped."""
    h2, w2 = h // 2, w // 2

    def blocks(x: np.ndarray) -> np.ndarray:
        return x[:, : 2 * h2, : 2 * w2].reshape(-1, h2, 2, w2, 2).mean(axis=(2, 4))

    return _per_field(fields, h, w, h2, w2, blocks)


def regrid_nearest(cells: DataFrame, h: int, w: int, h2: int, w2: int) -> DataFrame:
    """Target cell ``(a, b)`` copies source ``(a*h div h2, b*w div w2)``.

    Solved for the source: each cell emits the contiguous range of targets that read
    it, so there is no join.
    """
    def targets(idx: str, size: int, size2: int) -> Column:
        first = F.ceil(F.col(idx) * size2 / size).cast("int")
        last = (F.ceil((F.col(idx) + 1) * size2 / size) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    keep = [c for c in cells.columns if c not in ("i", "j")]
    rows = cells.select(*keep, "j", F.explode(targets("i", h, h2)).alias("_i"))
    return rows.select(*keep, "_i", F.explode(targets("j", w, w2)).alias("_j")).select(
        *keep, F.col("_i").alias("i"), F.col("_j").alias("j")
    )




def regrid_bilinear(fields: DataFrame, h: int, w: int, h2: int, w2: int) -> DataFrame:
    """Bilinear resampling with half-pixel centres and clamped edges.

    Two one-dimensional passes per field, across and then down.
    """
    def place(size: int, size2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pos = np.maximum((np.arange(size2) + 0.5) * (size / size2) - 0.5, 0.0)
        low = np.minimum(pos.astype(int), size - 1)
        return low, np.minimum(low + 1, size - 1), pos - np.floor(pos)

    ja, jb, jf = place(w, w2)
    ia, ib, fi = place(h, h2)
    down = fi[:, None]

    def resample(x: np.ndarray) -> np.ndarray:
        across = x[:, :, ja] * (1.0 - jf) + x[:, :, jb] * jf
        return across[:, ia] * (1.0 - down) + across[:, ib] * down

    return _per_field(fields, h, w, h2, w2, resample)


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    """Normalised one-dimensional kernel, centred."""
    half = (size - 1) / 2.0
    raw = [math.exp(-0.5 * ((k - half) / sigma) ** 2) for k in range(size)]
    return [x / sum(raw) for x in raw]


def gaussian_blur(fields: DataFrame, h: int, w: int, size: int, sigma: float) -> DataFrame:
    """Blur with replicated edges, as two one-dimensional passes per field."""
    if size % 2 == 0:
        raise ValueError("kernel size must be odd")
    kernel, half = gaussian_kernel(size, sigma), size // 2

    def blur(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x, ((0, 0), (0, 0), (half, half)), mode="edge")
        across = sum(k * wide[:, :, a : a + w] for a, k in enumerate(kernel))
        tall = np.pad(across, ((0, 0), (half, half), (0, 0)), mode="edge")
        return sum(k * tall[:, a : a + h] for a, k in enumerate(kernel))

    return _per_field(fields, h, w, h, w, blur)


def space_to_depth(cells: DataFrame, channels: int, factor: int, channel: str = "c") -> DataFrame:
    """Fold ``factor`` x ``factor`` blocks into channels ``(fi*factor + fj)*C + c``."""
    fi, fj = F.col("i") % factor, F.col("j") % factor
    return cells.withColumns(
        {
            channel: ((fi * factor + fj) * channels + F.col(channel)).cast("int"),
            "i": F.floor(F.col("i") / factor).cast("int"),
            "j": F.floor(F.col("j") / factor).cast("int"),
        }
    )


def depth_to_space(cells: DataFrame, channels: int, factor: int, channel: str = "c") -> DataFrame:
    """G09 inverse; ``channels`` is the number of channels of the result."""
    block = F.floor(F.col(channel) / channels)
    return cells.withColumns(
        {
            "i": (F.col("i") * factor + F.floor(block / factor)).cast("int"),
            "j": (F.col("j") * factor + block % factor).cast("int"),
            channel: (F.col(channel) % channels).cast("int"),
        }
    )


def latitude(i: Column, h: int) -> Column:
    """Latitude in degrees of row ``i`` of a pole-to-pole grid, north first."""
    return F.lit(90.0) - i * (180.0 / (h - 1))


def latitude_weight(i: Column, h: int) -> Column:
    """``cos(lat) / mean(cos(lat))`` of grid row ``i`` as an expression, so that scores need no join.

    A pole row covers no area and weighs exactly 0.
    """
    mean = sum(math.cos(math.radians(90.0 - k * 180.0 / (h - 1))) for k in range(1, h - 1)) / h
    return F.when(i.between(1, h - 2), F.cos(F.radians(latitude(i, h))) / mean).otherwise(F.lit(0.0))


def latitude_weights(rows: DataFrame, h: int, i: str = "i") -> DataFrame:
    """A table of grid rows with their latitude and weight."""
    return rows.select(i).distinct().withColumns(
        {"lat": latitude(F.col(i), h), "weight": latitude_weight(F.col(i), h)}
    )
