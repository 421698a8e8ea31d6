"""Channel statistics, normalisation, running means.

NULL and NaN cells never enter an aggregate; they are counted in ``n_null``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numeric import present
from ..sizing import BLOCK, reused
from .layout import let
from .packed import rows_of
from .scan import carried, placed, with_carried


def channel_stats(cells: DataFrame, keys: Sequence[str] = ("channel_idx",), value: str = "value") -> DataFrame:
    """Count, mean and *population* standard deviation per channel."""
    v = present(value)
    return cells.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.count(F.lit(1)) - F.count(v)).alias("n_null"),
    )


def merge_stats(parts: DataFrame, keys: Sequence[str] = ("channel_idx",)) -> DataFrame:
    """Combine partial (n, mean, std, n_null) rows, so increments never rescan the data.

    Uses the spread around the merged mean, which does not cancel like
    ``E[x^2] - E[x]^2`` does: the parts' own spread plus that of their means around the
    merged one.  A channel whose cells are all missing stays, with n = 0 and NULL moments.
    """
    n = F.sum("n")
    centre = parts.groupBy(*keys).agg(
        n.alias("_n"),
        F.sum("n_null").alias("_null"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), n).alias("_m"),
    )
    gap = F.col("mean") - F.col("_m")
    return (
        parts.join(centre, list(keys))
        .groupBy(*keys, "_n", "_null", "_m")
        .agg(F.sum(F.col("n") * (F.col("std") * F.col("std") + gap * gap)).alias("_ss"))
        .select(
            *keys,
            F.col("_n").alias("n"),
            F.col("_m").alias("mean"),
            F.sqrt(F.try_divide(F.col("_ss"), F.col("_n"))).alias("std"),
            F.col("_null").alias("n_null"),
        )
    )


def overall_stats(stats: DataFrame, variable: str = "variable", channel: str = "channel_idx") -> DataFrame:
    """One mean and std per variable over all its levels, repeated on each level.

    Works on the N01 table (plus its variable), so the data is not read again.
    """
    overall = merge_stats(stats, (variable,))
    return stats.select(variable, channel).join(overall, variable)


def standardize(cells: DataFrame, stats: DataFrame, norm_type: str = "channel",
                channel: str = "channel_idx", variable: str = "variable", value: str = "value") -> DataFrame:
    """``(x - mean) / std`` with per-channel or per-variable statistics; std 0 gives NULL,
    and so does a channel without statistics: no cell is lost."""
    if norm_type == "channel":
        key = channel
    elif norm_type == "overall":
        key, stats = variable, stats.select(variable, "mean", "std").distinct()
    else:
        raise ValueError("norm_type must be 'channel' or 'overall'")
    side = stats.select(key, F.col("mean").alias("_m"), F.col("std").alias("_s"))
    scaled = F.when(F.col("_s") != 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    return cells.join(side, key, "left").withColumn(value, scaled).drop("_m", "_s")


def destandardize(cells: DataFrame, stats: DataFrame, channel: str = "channel_idx",
                  value: str = "value") -> DataFrame:
    """``x * std + mean``; NULL for a channel without statistics."""
    side = stats.select(channel, F.col("mean").alias("_m"), F.col("std").alias("_s"))
    return (
        cells.join(side, channel, "left")
        .withColumn(value, F.col(value) * F.col("_s") + F.col("_m"))
        .drop("_m", "_s")
    )


def minmax_quantize(fields: DataFrame, levels: int = 65535) -> DataFrame:
    """Scale each field to 0..levels by its own minimum and range.  No shuffle.

    ``shift`` is the minimum and ``scale`` the range of the cells that are present;
    ``values`` become integers, truncated as an unsigned store truncates.  Missing cells
    (NULL or NaN) become NULL.  A constant field becomes all zeros.
    """

    @F.arrow_udf("struct<values: array<int>, shift: double, scale: double>")
    def store(batch: pa.Array) -> pa.Array:
        flat, ends, there = rows_of(batch)
        sizes = np.diff(ends, prepend=0)
        filled = np.flatnonzero(sizes > 0)
        missing = np.isnan(flat)
        low, high = np.full(len(sizes), np.nan), np.full(len(sizes), np.nan)
        if len(filled):
            starts = (ends - sizes)[filled]
            low[filled] = np.fmin.reduceat(flat, starts)
            high[filled] = np.fmax.reduceat(flat, starts)
        scale = high - low
        codes = np.zeros(len(flat), np.int32)
        for start, end, lo, by in zip((ends - sizes)[filled], ends[filled], low[filled], scale[filled]):
            if by > 0:
                x = (flat[start:end] - lo) / by * levels
                codes[start:end] = np.floor(np.where(missing[start:end], 0.0, x))
        values = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(~there, False)), pa.array(codes, mask=missing)
        )
        bounds = [pa.array(x, from_pandas=True) for x in (low, scale)]
        return pa.StructArray.from_arrays([values, *bounds], names=["values", "shift", "scale"])

    out = fields.withColumn("_stored", store(F.col("values").cast("array<double>")))
    return out.withColumns({c: F.col(f"_stored.{c}") for c in ("values", "shift", "scale")}).drop("_stored")


def minmax_dequantize(fields: DataFrame, levels: int = 65535) -> DataFrame:
    """``q / levels * scale + shift``, with the same ``levels`` as the store."""
    bounds = F.struct(F.col("shift").alias("lo"), F.col("scale").alias("by"))
    value = lambda q, m: q / F.lit(float(levels)) * m["by"] + m["lo"]
    return fields.withColumn(
        "values", let(bounds, lambda m: F.transform("values", lambda q: value(q, m)))
    )


def cumulative_mse(files: DataFrame, order: str, mse: str = "mse", keys: Sequence[str] = (),
                   block: int = BLOCK) -> DataFrame:
    """Running mean of per-file errors in file order; ``order`` is unique per ``keys``.

    Files without an error (NULL or NaN) do not count, as a file that cannot be read does not; the
    mean is 0 before the first one that does.  A parallel scan, see :mod:`scan`: blocks of at
    most ``block`` rows, whatever the gaps between the order values.
    """
    keys = list(keys)
    rows, steps = placed(files, keys, order, block)
    known = present(mse)
    summary = F.struct(F.coalesce(F.sum(known), F.lit(0.0)).alias("s"), F.count(known).alias("n"))
    parts = rows.groupBy(*keys, "_block").agg(summary.alias("_m"))
    add = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"))
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    upto = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = with_carried(rows, carried(parts, keys, none, add, steps), keys).withColumns(
        {"_s": F.coalesce(F.sum(known).over(upto), F.lit(0.0)) + F.col("_before.s"), "_n": F.count(known).over(upto) + F.col("_before.n")}
    )
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(0.0))
    return out.withColumn("running_mse", mean).select(*files.columns, "running_mse")


def latent_channel_means(fields: DataFrame, channel: str = "c") -> DataFrame:
    """Per channel, the mean over samples of each sample's spatial mean.

    The spatial mean is taken inside the packed row, over the cells that are present; only
    one value per field is shuffled.  A field without any does not count.
    """
    there = F.filter("values", lambda x: x.isNotNull() & ~F.isnan(x))
    spatial = let(there, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), F.size(v)))
    return fields.select(channel, spatial.alias("_m")).groupBy(channel).agg(F.avg("_m").alias("mean"))


def channel_range(cells: DataFrame, channel: str = "c", value: str = "sym") -> DataFrame:
    """Smallest and largest symbol per channel."""
    return cells.groupBy(channel).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def ema(series: DataFrame, decay: float, warmup: bool = True, keys: Sequence[str] = ("key",),
        order: str = "seq", value: str = "value", block: int = 1024) -> DataFrame:
    """Exponential moving average ``s -= (1 - d) * (s - x)``, started at the first value.

    With ``warmup``, update ``n`` uses ``d = min(decay, (1 + n) / (10 + n))``, counting
    from 1 at the second value.  ``order`` is unique per key.  A missing value (NULL or NaN) is no
    update: the average stays, and is NULL before the first value.

    An update is the affine map ``s -> d*s + (1-d)*x``, and maps compose.  So every block of at
    most ``block`` rows is folded to one map, the maps are combined by a parallel scan (see
    :mod:`scan`), and each block is then run from its carried-in state.
    """
    keys = list(keys)
    rows, steps = placed(series.select(*keys, order, present(value).cast("double").alias("_x")), keys, order, block)
    item = F.struct(F.col(order).alias("o"), F.col("_x").alias("x"))
    blocks = rows.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(item)).alias("_rows"))

    counts = blocks.select(*keys, "_block", F.size(F.filter("_rows", lambda r: r["x"].isNotNull())).cast("long").alias("_m"))
    zero = F.lit(0).cast("long")
    starts = carried(counts, keys, zero, lambda a, b: a + b, steps)
    blocks = reused(with_carried(blocks, starts, keys).withColumnRenamed("_before", "_start"))

    def rate(n: Column) -> Column:
        """The decay of the value after ``n`` others."""
        later = F.least(F.lit(decay), (n + 1) / (n + 10)) if warmup else F.lit(float(decay))
        return F.when(n == 0, F.lit(0.0)).otherwise(later)

    def fold(acc: Column, r: Column) -> Column:
        d = rate(acc["n"])
        moved = F.struct((acc["n"] + 1).alias("n"), (acc["a"] * d).alias("a"), (acc["b"] * d + (F.lit(1.0) - d) * r["x"]).alias("b"))
        return F.when(r["x"].isNull(), acc).otherwise(moved)

    same = lambda n: F.struct(n.alias("n"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    as_map = lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"))
    maps = blocks.select(*keys, "_block", F.aggregate("_rows", same(F.col("_start")), fold, as_map).alias("_m"))
    after = lambda m, k: F.struct((m["a"] * k["a"]).alias("a"), (m["b"] * k["a"] + k["b"]).alias("b"))
    neutral = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    states = with_carried(blocks, carried(maps, keys, neutral, after, steps), keys)

    done = F.slice(F.array(F.struct(F.col("_rows")[0]["o"].alias("o"), F.lit(None).cast("double").alias("s"))), 1, 0)
    begin = F.struct(F.col("_start").alias("n"), F.col("_before.b").alias("s"), done.alias("out"))

    def run(acc: Column, r: Column) -> Column:
        there = r["x"].isNotNull()
        s = F.when(there, acc["s"] - (F.lit(1.0) - rate(acc["n"])) * (acc["s"] - r["x"])).otherwise(acc["s"])
        n = acc["n"] + there.cast("long")
        shown = F.struct(r["o"].alias("o"), F.when(n > 0, s).alias("s"))
        return F.struct(n.alias("n"), s.alias("s"), F.concat(acc["out"], F.array(shown)).alias("out"))

    results = F.explode(F.aggregate("_rows", begin, run, lambda acc: acc["out"])).alias("_z")
    return states.select(*keys, results).select(*keys, F.col("_z.o").alias(order), F.col("_z.s").alias("ema"))
