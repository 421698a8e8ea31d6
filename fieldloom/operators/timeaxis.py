"""The time axis, lead-time samples, climatology and forecast steps."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.numeric import present
from .channels import pair_fields
from .layout import div
from .packed import field_means, rows_of

# The date ranges of the training, validation and test splits.
SPLIT_RANGES = {
    "train": ("1998-05-04", "2017-12-31"),
    "val": ("2018-01-01", "2018-12-31"),
    "test": ("2018-01-01", "2018-12-31"),
}


def _plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours)


def timestamp_grid(bounds: DataFrame, step_hours: int, start: str = "start", end: str = "end") -> DataFrame:
    """Every ``step_hours`` from start 00:00 to 23:00 of the end day, both inclusive."""
    if step_hours < 1:
        raise ValueError("step_hours must be at least 1")
    first = F.col(start).cast("date").cast("timestamp_ntz")
    last = _plus_hours(F.col(end).cast("date").cast("timestamp_ntz"), F.lit(23))
    step = F.make_dt_interval(F.lit(0), F.lit(step_hours))
    rest = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*rest, F.explode(F.sequence(first, last, step)).alias("ts"))


def lead_pairs(anchors: DataFrame, input_offsets: Sequence[int], target_offsets: Sequence[int],
               ts: str = "ts") -> DataFrame:
    """The timestamps each sample needs, one row per (anchor, role, position).

    Inputs sit at anchor + offset.  Targets are counted from the *last input*, not
    from the anchor.
    """
    last_input = input_offsets[-1]
    entry = lambda role, k, hours: F.struct(
        F.lit(role).alias("role"), F.lit(k).alias("k"), F.lit(hours).alias("hours")
    )
    wanted = [entry("input", k, o) for k, o in enumerate(input_offsets)]
    wanted += [entry("target", k, last_input + o) for k, o in enumerate(target_offsets)]
    return (
        anchors.withColumn("_e", F.explode(F.array(*wanted)))
        .withColumns({"role": F.col("_e.role"), "k": F.col("_e.k"),
                      "valid_ts": _plus_hours(F.col(ts), F.col("_e.hours"))})
        .drop("_e")
    )


def join_leads(pairs: DataFrame, data: DataFrame, ts: str = "ts") -> DataFrame:
    """Attach the data found at each ``valid_ts``: an equi-join on the timestamp."""
    return pairs.join(data.withColumnRenamed(ts, "valid_ts"), "valid_ts")


def anchors_lost(input_offsets: Sequence[int], target_offsets: Sequence[int], step_hours: int) -> int:
    return math.ceil(target_offsets[-1] / step_hours) + math.ceil(input_offsets[-1] / step_hours)


def valid_anchors(anchors: DataFrame, input_offsets: Sequence[int], target_offsets: Sequence[int],
                  step_hours: int, ts: str = "ts") -> DataFrame:
    """Drop the last anchors, whose targets would lie beyond the axis.

    ``anchors`` holds distinct timestamps.  The cut-off comes from a distributed
    top-k of the few rows to drop, not from ranking the whole axis.
    """
    lost = anchors_lost(input_offsets, target_offsets, step_hours)
    if lost <= 0:
        return anchors
    cut = anchors.select(F.col(ts).alias("_cut")).orderBy(F.desc("_cut")).limit(lost)
    return anchors.where(F.col(ts) < cut.agg(F.min("_cut")).scalar())


def limit_anchors(anchors: DataFrame, n: int, mode: str, ts: str = "ts") -> DataFrame:
    """Keep the first ``n`` timestamps, or skip them; 0 means no limit."""
    if mode not in ("keep", "skip"):
        raise ValueError("mode must be 'keep' or 'skip'")
    if not n:
        return anchors
    if mode == "keep":
        return anchors.orderBy(ts).limit(n)
    head = anchors.select(F.col(ts).alias("_cut")).orderBy("_cut").limit(n)
    return anchors.where(F.col(ts) > head.agg(F.max("_cut")).scalar())


def date_split(df: DataFrame, split: str, ranges: dict[str, tuple[str, str]] | None = None,
               ts: str = "ts") -> DataFrame:
    """Rows of one split.  Plain range predicates, so scans prune.

    The end day is included through its last hour.  A ``year`` partition column is
    filtered too when the table has one.
    """
    ranges = SPLIT_RANGES if ranges is None else ranges
    if split not in ranges:
        raise ValueError(f"unknown split {split!r}")
    first, last = ranges[split]
    out = df.where(
        (F.col(ts) >= F.lit(first).cast("timestamp_ntz"))
        & (F.col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    )
    if "year" in df.columns:
        out = out.where(F.col("year").between(int(first[:4]), int(last[:4])))
    return out


def month_day(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd")


def daily_climatology(cells: DataFrame, first_year: int, last_year: int, keys: Sequence[str],
                      ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per calendar day and ``keys`` (channel, cell) over the base years."""
    base = cells.where(
        (F.col(ts) >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz"))
        & (F.col(ts) < F.lit(f"{last_year + 1}-01-01").cast("timestamp_ntz"))
    )
    return base.groupBy(month_day(F.col(ts)).alias("md"), *keys).agg(F.avg(present(value)).alias("clim"))


def climatology_lookup(rows: DataFrame, clim: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Attach the climate mean of the row's calendar day; it stays un-normalised.

    A climatology of full fields is far too large to broadcast, so no hint is given:
    Spark joins by size.
    """
    return rows.withColumn("md", month_day(F.col(ts))).join(clim, ["md", *keys], "left")


def daily_climatology_fields(fields: DataFrame, first_year: int, last_year: int, keys: Sequence[str],
                             ts: str = "ts") -> DataFrame:
    """T07 on packed fields: one row per calendar day and ``keys`` (channel) with ``clim``, the means of all cells.

    At most one shuffle record per field.
    """
    base = fields.where(
        (F.col(ts) >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz"))
        & (F.col(ts) < F.lit(f"{last_year + 1}-01-01").cast("timestamp_ntz"))
    )
    means = field_means(base.withColumn("md", month_day(F.col(ts))), ["md", *keys])
    return means.withColumnRenamed("values", "clim")


def climatology_fields(fields: DataFrame, clim: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """T06 on packed fields: attach the climate field of each field's calendar day, one record per field.

    A day without climate gives NULL; Spark joins by size.
    """
    return fields.withColumn("md", month_day(F.col(ts))).join(clim.select("md", *keys, "clim"), ["md", *keys], "left")


def _with_halo(rows: DataFrame, hours: int, chunk_hours: int, ts: str) -> DataFrame:
    """Rows with their ``_hour`` and place ``_p`` (chunk ``at``, ``halo``); the last hours of a chunk are also the next one's halo."""
    if chunk_hours < hours:
        raise ValueError("chunk_hours must be at least hours")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    hour = F.timestamp_diff("HOUR", epoch, F.col(ts)).cast("long")
    rows = rows.withColumn("_hour", hour).withColumn("_chunk", F.floor(F.col("_hour") / chunk_hours))
    in_halo = (F.col("_hour") - F.col("_chunk") * chunk_hours) > chunk_hours - hours
    both = F.array(
        F.struct(F.col("_chunk").alias("at"), F.lit(False).alias("halo")),
        F.struct((F.col("_chunk") + 1).alias("at"), F.lit(True).alias("halo")),
    )
    own = F.slice(both, 1, 1)
    return rows.withColumn("_p", F.explode(F.when(in_halo, both).otherwise(own)))


def accumulate_fields(fields: DataFrame, hours: int, keys: Sequence[str], ts: str = "ts", chunk_hours: int = 720) -> DataFrame:
    """T08 on packed fields: ``accumulated``, the cell-wise sums of the last ``hours`` fields.

    NULL unless all those hours are there; a cell that is missing in one of them is NULL.  Whole fields
    are the halo between chunks of the time axis; a task streams a chunk in order and holds
    ``hours`` fields.  A repeated hour and fields of different sizes are errors.
    """
    keys = list(keys)
    placed = _with_halo(fields, hours, chunk_hours, ts)
    rows = placed.select(*fields.columns, "_hour", F.col("_p.at").alias("_at"), F.col("_p.halo").alias("_halo"))
    rows = rows.repartition(*keys, "_at").sortWithinPartitions(*keys, "_at", "_hour")
    names = fields.columns
    schema = T.StructType([*fields.schema.fields, T.StructField("accumulated", T.ArrayType(T.DoubleType()))])

    def add_up(batches):
        before, held = None, deque(maxlen=hours)
        for batch in batches:
            flat, ends, there = rows_of(batch.column("values"))
            series = zip(*(batch.column(k).to_pylist() for k in [*keys, "_at"]))
            kept, sums = [], []
            halo = batch.column("_halo").to_pylist()
            for row, (key, hour, start, end, ok) in enumerate(zip(series, batch.column("_hour").to_pylist(), [0, *ends[:-1]], ends, there)):
                if key != before:
                    held.clear()
                    before = key
                if held and held[-1][0] == hour:
                    raise ValueError("an hour is repeated")
                held.append((hour, flat[start:end] if ok else None))
                if halo[row]:
                    continue
                kept.append(row)
                whole = len(held) == hours and held[0][0] == hour - hours + 1 and all(x is not None for _, x in held)
                if whole and len({len(x) for _, x in held}) > 1:
                    raise ValueError("fields of one series differ in size")
                sums.append(sum((x for _, x in held), 0.0) if whole else None)
            offsets = np.concatenate([[0], np.cumsum([0 if s is None else len(s) for s in sums])]).astype(np.int32)
            numbers = np.concatenate([np.zeros(0), *[s for s in sums if s is not None]])
            absent = np.array([s is None for s in sums] + [False])
            lists_ = pa.ListArray.from_arrays(pa.array(offsets, mask=absent), pa.array(numbers, mask=np.isnan(numbers)))
            taken = [batch.column(c).take(pa.array(kept, pa.int64())) for c in names]
            # A batch keeps nothing of its buffers alive but the fields still needed.
            held = deque(((h, x if x is None else x.copy()) for h, x in held), maxlen=hours)
            yield pa.RecordBatch.from_arrays([*taken, lists_], [*names, "accumulated"])

    return rows.mapInArrow(add_up, schema)


def accumulate_hours(cells: DataFrame, hours: int, keys: Sequence[str], ts: str = "ts",
                     value: str = "value", chunk_hours: int = 720) -> DataFrame:
    """Sum of the last ``hours`` hourly values; NULL unless all are present.

    Input is unique per (keys, hour).  The axis is cut into chunks and the last
    ``hours - 1`` hours of a chunk are copied into the next one, so a window holds at
    most ``chunk_hours + hours - 1`` rows however long the series is.
    """
    placed = _with_halo(cells, hours, chunk_hours, ts)
    w = W.partitionBy(*keys, "_p.at").orderBy("_hour").rangeBetween(-(hours - 1), 0)
    return (
        placed.withColumns({"_n": F.count(present(value)).over(w), "_s": F.sum(present(value)).over(w)})
        .where(~F.col("_p.halo"))
        .select(*keys, ts, value, F.when(F.col("_n") == hours, F.col("_s")).alias("accumulated"))
    )


def every_kth_step(steps: DataFrame, run: Sequence[str], order: str, first: int, step: int, n: int) -> DataFrame:
    """From each forecast run take steps ``first``, ``first+step``, ... at most ``n``.

    One row per (run, step).  The literal bound on the rank lets Spark keep only the
    leading rows of a run before the shuffle.
    """
    if step < 1 or n < 0 or first < 0:
        raise ValueError("need step >= 1, first >= 0 and n >= 0")
    rank = F.row_number().over(W.partitionBy(*run).orderBy(order))
    ranked = steps.withColumn("_rn", rank).where(F.col("_rn") <= first + max(n - 1, 0) * step + 1)
    idx = F.col("_rn") - 1 - first
    return (
        ranked.where((idx >= 0) & (idx % step == 0) & (idx < n * step))
        .withColumn("slot", F.floor(idx / step).cast("int"))
        .drop("_rn")
    )


def forecast_truth_pairs(pred: DataFrame, truth: DataFrame, keys: Sequence[str],
                         valid_ts: str = "valid_ts", ts: str = "ts",
                         pred_value: str = "value", truth_value: str = "value") -> DataFrame:
    """Pair every forecast value with the truth at its valid time."""
    t = truth.select(F.col(ts).alias(valid_ts), *keys, F.col(truth_value).alias("truth"))
    p = pred.withColumnRenamed(pred_value, "pred")
    return p.join(t, [valid_ts, *keys])


def forecast_truth_fields(pred: DataFrame, truth: DataFrame, keys: Sequence[str], carry: Sequence[str] = ("lead",),
                          valid_ts: str = "valid_ts", ts: str = "ts") -> DataFrame:
    """T10 on packed fields: one row per field is joined, then the pairs are exploded.

    The shuffle carries whole arrays, not one keyed row per cell.
    """
    rows = pair_fields(pred, truth.withColumnRenamed(ts, valid_ts), [valid_ts, *keys], carry)
    return rows.withColumnsRenamed({"orig": "pred", "recon": "truth"})


def forecast_fields(pred: DataFrame, truth: DataFrame, keys: Sequence[str], valid_ts: str = "valid_ts",
                    ts: str = "ts") -> DataFrame:
    """T10 left packed: every forecast field with the true field of its valid time, as ``pred`` and ``truth``."""
    t = truth.select(F.col(ts).alias(valid_ts), *keys, F.col("values").alias("truth"))
    return pred.withColumnRenamed("values", "pred").join(t, [valid_ts, *keys])


def lead_curriculum(iterations: DataFrame, interval: int, n_targets: int, window: int,
                    iteration: str = "iteration") -> DataFrame:
    """Iteration number (from 1) -> target positions ``[first, last)`` trained on.

    The stage grows every ``interval`` iterations and wraps; odd iterations go back to
    an earlier stage.  A closed form, so any slice of iterations can be computed alone.
    """
    stages = n_targets // window
    if stages < 1:
        raise ValueError("window must not exceed n_targets")
    it, one = F.col(iteration).cast("long"), F.lit(1).cast("long")
    stage = F.greatest(div(it + interval, interval) % stages, one)
    odd_turn = div(it + 1, 2)
    chosen = F.when(it % 2 == 1, F.greatest(odd_turn % F.col("_s"), one)).otherwise(F.col("_s"))
    return (
        iterations.withColumn("_s", stage)
        .withColumn("stage", chosen)
        .withColumns({"first": (F.col("stage") - 1) * window, "last": F.col("stage") * window})
        .drop("_s")
    )
