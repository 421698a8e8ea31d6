"""Symbol statistics, quantised CDFs, context models and coding order.

The large table is read once per question and reduced to counts before anything else
happens: CDFs, entropies and searches all work on histograms, whose size depends on
the number of channels and symbols but not on the number of samples.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sizing import reused
from .bands import band_rows, pair_counts
from .layout import div, positions
from .tables import cdf_rows, coded_bits

# CDF precision in bits; channels with a support this narrow or narrower
# are never searched for; contexts of the spatial model (the one with channels has one more).
PRECISION = 16
TOTAL = 1 << PRECISION
NARROW_RANGE = 4
SPATIAL_CONTEXTS = 3


def symbol_histogram(cells: DataFrame, keys: Sequence[str] = ("c",), sym: str = "sym") -> DataFrame:
    """Count per (channel, symbol)."""
    return cells.groupBy(*keys, sym).agg(F.count(F.lit(1)).alias("n"))


def symbol_support(hist: DataFrame, channel: Sequence[str] = ("c",), sym: str = "sym") -> DataFrame:
    """Per channel the range of symbols, widened by one on both sides."""
    widened = hist.groupBy(*channel).agg(
        (F.min(sym) - 1).alias("lo"), (F.max(sym) + 1).alias("hi")
    )
    half = 1 << (PRECISION - 1)
    fits = (F.col("lo") > -half) & (F.col("hi") < half)
    checked = F.when(fits, F.col("lo")).otherwise(F.raise_error(F.lit("symbol out of range")).cast("int"))
    return widened.withColumn("lo", checked)


def symbol_cdf(hist: DataFrame, keys: Sequence[str] = ("c",), support: DataFrame | None = None,
               groups: DataFrame | None = None, channel: Sequence[str] = ("c",),
               sym: str = "sym") -> DataFrame:
    """16-bit cumulative table per group, one row per (group, k).

    Symbol ``lo + k`` occupies ``[cproba[k], cproba[k+1])``; ``step`` is that width and
    is NULL on the closing row.  Steps are at least 1, the last value is 65536, and the
    values below are pulled down to stay strictly increasing.  That pull-down is
    ``min over m >= k of (c[m] - m) + k``, so no loop is needed.

    ``groups`` lists the groups that must get a table even if they have no symbols.
    """
    support = symbol_support(hist, channel, sym) if support is None else support
    # Missing symbols have no code: they are no part of the whole, and an entropy counts them as unpriced.
    return cdf_rows(hist, list(keys), support, groups, list(channel), sym, TOTAL)


def most_probable_symbol(cdf: DataFrame, keys: Sequence[str] = ("c",), sym: str = "sym") -> DataFrame:
    """The symbol with the widest step, the first one on ties."""
    best = F.max(F.struct(F.col("step"), (-F.col("k")).alias("_k"), F.col(sym).alias("_s")))
    return (
        cdf.where(F.col("step").isNotNull())
        .groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, F.col("_b._s").alias("mode"), F.col("_b.step").alias("step"))
    )


def weighted_bits(hist: DataFrame, cdf: DataFrame, keys: Sequence[str], out: Sequence[str],
                  sym: str = "sym") -> DataFrame:
    """Mean bits per symbol of a histogram under a CDF: histogram rows meet CDF rows.

    ``n`` counts the symbols that the CDF can code, ``n_unpriced`` those outside it, for which
    there is no number of bits.
    """
    step = F.col("step").cast("double")
    bits = F.lit(float(PRECISION)) - F.log2(step)
    joined = hist.join(cdf.where("step IS NOT NULL").select(*keys, sym, "step"), [*keys, sym], "left")
    priced = F.sum(F.when(step.isNotNull(), F.col("n")))
    return joined.groupBy(*out).agg(
        F.try_divide(F.sum(F.col("n") * bits), priced).alias("bits"),
        F.coalesce(priced, F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(step.isNull(), F.col("n"))), F.lit(0)).alias("n_unpriced"),
    )


def own_bits(hist: DataFrame, keys: Sequence[str], out: Sequence[str], support: DataFrame,
             channel: Sequence[str] = ("c",), sym: str = "sym") -> DataFrame:
    """:func:`weighted_bits` of a histogram under the CDF of its own groups, made where the counts are."""
    each = coded_bits(hist, list(keys), support, list(channel), sym, PRECISION)
    n = F.sum("n")
    return each.groupBy(*out).agg(
        F.try_divide(F.sum("_bits"), n).alias("bits"), n.alias("n"), F.sum("n_unpriced").alias("n_unpriced")
    )


def cross_entropy(hist: DataFrame, cdf: DataFrame, keys: Sequence[str] = ("c",), sym: str = "sym") -> DataFrame:
    """Mean bits per symbol, ``16 - log2(step)``; symbols outside the CDF are counted apart."""
    return weighted_bits(hist, cdf, keys, keys, sym)


def _neighbours(values: Column, pos: Column, w: Column) -> tuple[Column, Column]:
    """The cell above and the cell to the left, NULL at the edge."""
    return F.get(values, pos - w), F.when(pos % w > 0, F.get(values, pos - 1))


def neighbour_deviation(fields: DataFrame, modes: DataFrame, keys: Sequence[str] = ("sample", "c"),
                        channel: str = "c") -> DataFrame:
    """Cells with the distance of the upper and left neighbour from the channel's mode.

    Neighbours are looked up inside the packed row, so there is no shuffle.  A missing
    neighbour has deviation -1.  Further columns of ``modes`` are carried along.
    """
    side = modes
    carried = [x for x in modes.columns if x not in (channel, "mode")]
    values, pos, w = F.col("values"), F.col("_pos"), F.col("w")
    up, left = _neighbours(values, pos, w)
    dev = lambda x: F.coalesce(F.abs(x - F.col("mode")), F.lit(-1))
    return (
        fields.join(side, channel)
        .select(*keys, "w", "mode", *carried, "values", positions(values).alias("_pos"))
        .select(
            *keys, *carried,
            div(pos, w).cast("int").alias("i"),
            (pos % w).cast("int").alias("j"),
            F.get(values, pos).alias("sym"),
            dev(up).alias("up_dev"),
            dev(left).alias("left_dev"),
            F.abs(F.get(values, pos) - F.col("mode")).alias("own_dev"),
        )
    )


def _context(th):
    return ((F.col("up_dev") > th).cast("int") + (F.col("left_dev") > th).cast("int"))


def spatial_context(fields: DataFrame, modes: DataFrame, thresholds: DataFrame,
                    keys: Sequence[str] = ("sample", "c"), channel: str = "c") -> DataFrame:
    """Context 0..2 of every cell: how many of the upper and left neighbour lie
    further than the channel's threshold ``th`` from its mode."""
    side = modes.select(channel, "mode").join(thresholds.select(channel, "th"), channel)
    cells = neighbour_deviation(fields, side, keys, channel)
    return cells.withColumn("ctx", _context(F.col("th"))).select(
        *keys, "i", "j", "sym", "own_dev", "th", "ctx"
    )


def context_histogram(cells: DataFrame, keys: Sequence[str] = ("c", "ctx"), sym: str = "sym") -> DataFrame:
    """Counts per (channel, context, symbol)."""
    return symbol_histogram(cells, keys, sym)


def _all_contexts(support: DataFrame, channel: Sequence[str], contexts: int) -> DataFrame:
    return support.select(*channel, F.explode(F.sequence(F.lit(0), F.lit(contexts - 1))).alias("ctx"))


def context_cdf(hist: DataFrame, contexts: int = SPATIAL_CONTEXTS, channel: Sequence[str] = ("c",),
                support: DataFrame | None = None, sym: str = "sym") -> DataFrame:
    """E02 per (channel, context) over the channel's support.

    A context without symbols gets steps of 1 and one large last step.
    """
    support = symbol_support(hist, channel, sym) if support is None else support
    groups = _all_contexts(support, channel, contexts)
    return symbol_cdf(hist, [*channel, "ctx"], support, groups, channel, sym)


def context_entropy(hist: DataFrame, cdf: DataFrame, channel: Sequence[str] = ("c",),
                    sym: str = "sym") -> DataFrame:
    """Mean bits per symbol of each channel under its context tables."""
    return weighted_bits(hist, cdf, [*channel, "ctx"], channel, sym)


def threshold_entropy(fields: DataFrame, modes: DataFrame, support: DataFrame,
                      keys: Sequence[str] = ("sample", "c")) -> DataFrame:
    """Bits per symbol of every channel under every candidate threshold.

    A context only asks how many of the two neighbours deviate by more than the threshold: the
    larger deviation tells whether any does, the smaller one whether both do.  So cells are
    counted by (channel, symbol, deviation) for either, and running sums over the
    deviation give the counts of all thresholds.  The data is read once, and the counts
    grow with the square of the symbol range.
    """
    limits = support.join(modes, "c").select(
        "c",
        "mode",
        F.greatest(
            F.lit(1),
            F.least(F.abs(F.col("lo") - F.col("mode")), F.abs(F.col("hi") - F.col("mode"))),
        ).alias("th_max"),
    )
    up, left = F.col("up_dev"), F.col("left_dev")
    either = F.array(
        F.struct(F.least(up, left, "th_max").alias("dev"), F.lit(1).alias("small"), F.lit(0).alias("large")),
        F.struct(F.least(F.greatest(up, left), "th_max").alias("dev"), F.lit(0).alias("small"), F.lit(1).alias("large")),
    )
    counted = reused(
        neighbour_deviation(fields, limits, keys)
        .select("c", "sym", "th_max", F.explode(either).alias("_d"))
        .groupBy("c", "sym", "th_max", F.col("_d.dev").alias("th"))
        .agg(F.sum("_d.small").alias("_small"), F.sum("_d.large").alias("_large"))
    )
    every = counted.groupBy("c", "sym", "th_max").agg(F.sum("_small").alias("_all"))
    every = every.withColumn("th", F.explode(F.sequence(F.lit(-1), F.col("th_max") - 1)))
    upto = W.partitionBy("c", "sym").orderBy("th").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = every.join(counted.drop("th_max"), ["c", "sym", "th"], "left").withColumns(
        {"_small": F.sum(F.coalesce("_small", F.lit(0))).over(upto), "_large": F.sum(F.coalesce("_large", F.lit(0))).over(upto)}
    )
    per_context = F.array(F.col("_large"), F.col("_small") - F.col("_large"), F.col("_all") - F.col("_small"))
    hist = near.where("th >= 0").select("c", "th", "sym", F.posexplode(per_context).alias("ctx", "n")).where("n > 0")
    return own_bits(hist, ["c", "th", "ctx"], ["c", "th"], support)


def best_threshold(entropies: DataFrame) -> DataFrame:
    """Per channel the threshold with the fewest bits, the smallest one on ties.

    Bits are compared to nine digits, so that the order of summation cannot decide a tie.
    """
    best = F.min(F.struct(F.round("bits", 9).alias("_r"), F.col("th"), F.col("bits")))
    return entropies.groupBy("c").agg(best.alias("_b")).select(
        "c", F.col("_b.th").alias("th"), F.col("_b.bits").alias("bits")
    )


def channel_context(fields: DataFrame, modes: DataFrame, thresholds: DataFrame, order: DataFrame) -> DataFrame:
    """E05 plus one if the co-located symbol of the previous channel deviates too.

    ``order`` has (pos, c).  A previous threshold below 0 means "use this channel's own".
    The previous channel is fetched packed, one row per field, not cell by cell.
    """
    prev_of = order.select("c", "pos").join(
        order.select(F.col("c").alias("prev"), (F.col("pos") + 1).alias("pos")), "pos", "left"
    )
    table = modes.join(thresholds, "c")
    plan = prev_of.join(
        table.select(F.col("c").alias("prev"), F.col("mode").alias("prev_mode"), F.col("th").alias("prev_th")),
        "prev", "left",
    ).join(table.select("c", "mode", "th"), "c")
    side = plan.select("c", "mode", "th", "prev", "prev_mode", "prev_th")
    cur = fields.join(side, "c")
    prev = fields.select("sample", F.col("c").alias("prev"), F.col("values").alias("_pv"))
    paired = cur.join(prev, ["sample", "prev"], "left")

    values, pos, w = F.col("values"), F.col("_pos"), F.col("w")
    up, left = _neighbours(values, pos, w)
    far = lambda x, m, t: F.coalesce((F.abs(x - m) > t).cast("int"), F.lit(0))
    prev_limit = F.when(F.col("prev_th") >= 0, F.col("prev_th")).otherwise(F.col("th"))
    ctx = (
        far(up, F.col("mode"), F.col("th"))
        + far(left, F.col("mode"), F.col("th"))
        + far(F.get(F.col("_pv"), pos), F.col("prev_mode"), prev_limit)
    )
    carried = ("w", "mode", "th", "prev_mode", "prev_th", "values", "_pv")
    return paired.select("sample", "c", *carried, positions(values).alias("_pos")).select(
        "sample", "c",
        div(pos, w).cast("int").alias("i"),
        (pos % w).cast("int").alias("j"),
        F.get(values, pos).alias("sym"),
        ctx.alias("ctx"),
    )


def channel_context_entropy(fields: DataFrame, modes: DataFrame, thresholds: DataFrame, order: DataFrame,
                            support: DataFrame) -> DataFrame:
    """Bits per symbol with four contexts, the previous channel taken from ``order``."""
    hist = context_histogram(channel_context(fields, modes, thresholds, order))
    return own_bits(hist, ["c", "ctx"], ["c"], support)


def channel_gains(fields: DataFrame, modes: DataFrame, thresholds: DataFrame, support: DataFrame,
                  default_bits: DataFrame) -> DataFrame:
    """Bits saved on channel ``c`` when ``prev`` is coded right before it, for all wide pairs.

    Bands of cells meet as bitmaps, one record per (sample, channel, band); masks and population
    counts then give, per (channel, context, symbol), how many cells deviate in every other
    channel, see :mod:`bands`.  No cell is shuffled; only the counts grow with the square of
    the number of channels.
    """
    wide = support.where(F.col("hi") - F.col("lo") > NARROW_RANGE).select("c", "lo")
    # One row per channel is numbered, never data.
    numbers = reused(wide.select("c", "lo", (F.row_number().over(W.orderBy("c")) - 1).alias("k")))
    side = numbers.join(modes.select("c", "mode"), "c").join(thresholds.select("c", "th"), "c")
    counts = pair_counts(band_rows(fields, side), numbers.count())
    per_prev = (
        counts.join(numbers, "k")
        .select("c", "ctx", (F.col("lo") + F.col("sym_at")).cast("int").alias("sym"), F.col("n").alias("_n"),
                F.posexplode("hits").alias("_prev", "hit"))
        .join(numbers.select(F.col("c").alias("prev"), F.col("k").alias("_prev")), "_prev")
        .where(F.col("prev") != F.col("c"))
    )
    after = F.array(
        F.struct((F.col("ctx") + 1).alias("ctx"), F.col("hit").alias("n")),
        F.struct(F.col("ctx").alias("ctx"), (F.col("_n") - F.col("hit")).alias("n")),
    )
    hist = (
        per_prev.select("prev", "c", "sym", F.explode(after).alias("_h"))
        .where(F.col("_h.n") > 0)
        .groupBy("prev", "c", F.col("_h.ctx").alias("ctx"), "sym")
        .agg(F.sum("_h.n").alias("n"))
    )
    cost = own_bits(hist, ["prev", "c", "ctx"], ["prev", "c"], support)
    return cost.join(default_bits.select("c", F.col("bits").alias("_d")), "c").select(
        "prev", "c", (F.col("_d") - F.col("bits")).alias("gain")
    )


def channel_order(support: DataFrame, gains: DataFrame) -> DataFrame:
    """Greedy coding order.

    Start at the widest channel; keep appending the wide channel that gains most from
    the one just placed (first on ties, gain above -1); wide channels left over when no
    gain qualifies follow by index, narrow ones come last.

    Every choice is one distributed minimum over the table of channel pairs; only the chosen
    channel reaches the driver.  The steps depend on each other, so there is a job for each.
    """
    gains = reused(gains.select("prev", "c", F.round("gain", 9).alias("gain")))
    width = F.col("hi") - F.col("lo")
    wide = reused(support.select("c", (width > NARROW_RANGE).alias("wide"), width.alias("width")))
    placed = [wide.agg(F.max_by("c", F.struct("width", -F.col("c")))).first()[0]]
    while placed[-1] is not None:
        options = gains.where((F.col("prev") == placed[-1]) & ~F.col("c").isin(placed) & (F.col("gain") > -1))
        placed.append(options.agg(F.min_by("c", F.struct(-F.col("gain"), F.col("c")))).first()[0])
    placed.pop()
    at = F.array_position(F.array(*[F.lit(c) for c in placed]), F.col("c")) - 1
    order = F.when(at >= 0, at).when(F.col("wide"), len(placed)).otherwise(len(placed) + 1)
    # One row per channel is numbered, never data.
    position = (F.row_number().over(W.orderBy(order, "c")) - 1).alias("pos")
    return wide.select(position, "c")


def channel_activation(fields: DataFrame, modes: DataFrame) -> DataFrame:
    """16-bit share of samples in which a channel has any symbol off its mode.

    Decided inside each packed row, so one flag per field is shuffled.
    """
    side = modes.select("c", "mode")
    active = F.exists("values", lambda x: x != F.col("mode")).cast("long")
    share = F.round(F.sum("_a") * (F.lit(float(TOTAL)) / F.count(F.lit(1)))).cast("int")
    return (
        fields.join(side, "c")
        .select("c", active.alias("_a"))
        .groupBy("c")
        .agg(F.greatest(F.lit(1), F.least(F.lit(TOTAL - 1), share)).alias("proba"))
    )


def pmf_to_cdf(pmf: DataFrame, keys: Sequence[str] = ("c",), k: str = "k", p: str = "p",
               precision: int = PRECISION) -> DataFrame:
    """Probability table -> strictly increasing integer CDF, one row per edge.

    A bin that rounds to nothing takes one count from the narrowest bin wider than 1
    (the first on ties).  That step is sequential over one channel's table, whose length
    is bounded by the precision, so it runs per channel in pandas.  Negative, non-finite
    and all-zero tables are errors.
    """
    keys = list(keys)
    total = 1 << precision

    def quantise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(k)
        prob = pdf[p].to_numpy(dtype=float)
        if len(prob) > total:
            raise ValueError("more symbols than counts")
        if not np.isfinite(prob).all() or (prob < 0).any():
            raise ValueError("pmf has a negative or non-finite entry")
        freq = np.floor(prob * total + 0.5).astype(np.int64)
        if freq.sum() == 0:
            raise ValueError("pmf has no positive entry")
        width = np.diff(np.concatenate(([0], np.cumsum(freq * total // freq.sum()))))
        # The last edge is pinned to the total, so the last bin takes what is left.
        width[-1] += total - width.sum()
        donors = [(int(n), at) for at, n in enumerate(width) if n > 1]
        heapq.heapify(donors)  # the narrowest first, then the first
        for at in np.flatnonzero(width == 0):
            n, donor = heapq.heappop(donors)
            width[donor], width[at] = n - 1, 1
            if n > 2:
                heapq.heappush(donors, (n - 1, donor))
        edges = np.concatenate(([0], np.cumsum(width)))
        head = {c: [pdf[c].iat[0]] * len(edges) for c in keys}
        return pd.DataFrame({**head, "k": np.arange(len(edges), dtype=np.int32), "cproba": edges})

    fields = [pmf.schema[c] for c in keys]
    schema = T.StructType([*fields, T.StructField("k", T.IntegerType()), T.StructField("cproba", T.LongType())])
    return pmf.select(*keys, k, p).groupBy(*keys).applyInPandas(quantise, schema)
