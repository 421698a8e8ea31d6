"""Scoring reconstructions, forecasts and codec sweeps.

NULL and NaN cells are missing: a pair counts only if both of its cells are present.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, present, psnr_from_mse, ratio_to_db  # noqa: F401  (M09 lives with the expressions)
from .packed import matrix
from .spatial import latitude_weight
from .statistics import merge_stats


def _gap(a: str, b: str) -> Column:
    return present(a) - present(b)


def channel_error_table(pairs: DataFrame, keys: Sequence[str] = ("channel_idx",), orig: str = "orig",
                        recon: str = "recon") -> DataFrame:
    """RMSE, MAE, largest error, cell count and missing cells per channel, from paired cells."""
    gap = _gap(orig, recon)
    return pairs.groupBy(*keys).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.max(F.abs(gap)).alias("max_error"),
        F.count(gap).alias("n"),
        (F.count(F.lit(1)) - F.count(gap)).alias("n_null"),
    )


def mse(pairs: DataFrame, keys: Sequence[str], orig: str = "orig", recon: str = "recon") -> DataFrame:
    """Mean squared error by any grouping."""
    gap = _gap(orig, recon)
    return pairs.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))


def weighted_rmse(pairs: DataFrame, h: int, keys: Sequence[str], time: str = "valid_ts", row: str = "i",
                  pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Latitude-weighted RMSE per ``keys`` (lead, channel).

    Per time the root of the spatial weighted mean, then the mean over times.  The
    weight is an expression of the row index, so no table is joined.
    """
    wt = latitude_weight(F.col(row), h)
    gap = _gap(pred, truth)
    per_time = pairs.groupBy(*keys, time).agg(
        F.sqrt(F.try_divide(F.sum(wt * gap * gap), F.sum(F.when(gap.isNotNull(), wt)))).alias("_r")
    )
    return per_time.groupBy(*keys).agg(F.avg("_r").alias("wrmse"), F.count("_r").alias("n_times"))


def anomaly_correlation(pairs: DataFrame, h: int, keys: Sequence[str], time: str = "valid_ts",
                        row: str = "i", pred: str = "pred", truth: str = "truth",
                        clim: str = "clim") -> DataFrame:
    """Latitude-weighted correlation of forecast and true anomalies.

    Anomalies are taken from climatology.  Per time one correlation over the cells that have
    a forecast, a truth and a climate, then the mean over the ``n_times`` times that have one.
    """
    wt = latitude_weight(F.col(row), h)
    a, b = _gap(pred, clim), _gap(truth, clim)
    both = a.isNotNull() & b.isNotNull()
    per_time = pairs.groupBy(*keys, time).agg(
        F.sum(wt * a * b).alias("_ab"),
        F.sum(F.when(both, wt * a * a)).alias("_aa"),
        F.sum(F.when(both, wt * b * b)).alias("_bb"),
    )
    norm = F.sqrt(F.col("_aa") * F.col("_bb"))
    acc = F.when(norm > 0, F.col("_ab") / norm)
    return per_time.groupBy(*keys).agg(F.avg(acc).alias("acc"), F.count(acc).alias("n_times"))


def bias_activity(pairs: DataFrame, keys: Sequence[str], pred: str = "pred", truth: str = "truth",
                  clim: str = "clim") -> DataFrame:
    """Mean error, and the (population) spread of the forecast and true anomalies.

    All three over the same cells: those with a forecast, a truth and a climate.
    """
    a, b = _gap(pred, clim), _gap(truth, clim)
    both = a.isNotNull() & b.isNotNull()
    return pairs.groupBy(*keys).agg(
        F.avg(F.when(both, _gap(pred, truth))).alias("bias"),
        F.stddev_pop(F.when(both, a)).alias("activity_pred"),
        F.stddev_pop(F.when(both, b)).alias("activity_truth"),
    )


def _row_weights(h: int, w: int) -> np.ndarray:
    """The latitude weights of all cells of a packed field."""
    lat = np.radians(90.0 - np.arange(h) * 180.0 / (h - 1))
    area = np.where((np.arange(h) > 0) & (np.arange(h) < h - 1), np.cos(lat), 0.0)
    return np.repeat(area / area.mean(), w)


def _field_sums(names: Sequence[str], h: int, w: int, kernel):
    """An Arrow function of packed fields whose ``kernel`` gives one number per field for each name."""
    schema = "struct<" + ", ".join(f"{n}: double" for n in names) + ">"

    @F.arrow_udf(schema)
    def run(*columns: pa.Array) -> pa.Array:
        with np.errstate(invalid="ignore", divide="ignore"):
            out = kernel(*[matrix(c, h * w) for c in columns])
        return pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in out], names=list(names))

    return lambda *columns: run(*[F.col(c).cast("array<double>") for c in columns])


def _per_field(a: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(good, a, 0.0).sum(axis=1)


def weighted_rmse_fields(pairs: DataFrame, h: int, w: int, keys: Sequence[str], pred: str = "pred",
                         truth: str = "truth") -> DataFrame:
    """M03 on packed pairs, one row per (``keys``, time): scored inside the row, one number per field is shuffled."""
    wt = _row_weights(h, w)

    def kernel(p, t):
        gap = p - t
        good = ~np.isnan(gap)
        weight = good @ wt
        return (np.where(weight > 0, np.sqrt(_per_field(wt * gap * gap, good) / weight), np.nan),)

    score = _field_sums(["r"], h, w, kernel)
    rows = pairs.select(*keys, score(pred, truth).alias("_f")).select(*keys, F.col("_f.r").alias("_r"))
    return rows.groupBy(*keys).agg(F.avg("_r").alias("wrmse"), F.count("_r").alias("n_times"))


def anomaly_correlation_fields(pairs: DataFrame, h: int, w: int, keys: Sequence[str], pred: str = "pred",
                               truth: str = "truth", clim: str = "clim") -> DataFrame:
    """M04 on packed pairs with their climate: one correlation per row, then the mean over the times that have one."""
    wt = _row_weights(h, w)

    def kernel(p, t, c):
        a, b = p - c, t - c
        good = ~np.isnan(a * b)
        norm = np.sqrt(_per_field(wt * a * a, good) * _per_field(wt * b * b, good))
        return (np.where(norm > 0, _per_field(wt * a * b, good) / norm, np.nan),)

    score = _field_sums(["acc"], h, w, kernel)
    rows = pairs.select(*keys, score(pred, truth, clim).alias("_f")).select(*keys, F.col("_f.acc").alias("_acc"))
    return rows.groupBy(*keys).agg(F.avg("_acc").alias("acc"), F.count("_acc").alias("n_times"))


def bias_activity_fields(pairs: DataFrame, h: int, w: int, keys: Sequence[str], pred: str = "pred",
                         truth: str = "truth", clim: str = "clim") -> DataFrame:
    """M05 on packed pairs with their climate.

    Every field gives its count, mean gap, and mean and spread of both anomalies; these merge
    around the common means, which do not cancel.
    """
    def kernel(p, t, c):
        a, b = p - c, t - c
        good = ~np.isnan(a * b)
        n = good.sum(axis=1)
        mean = lambda x: _per_field(x, good) / n
        spread = lambda x, m: np.sqrt(_per_field((x - m[:, None]) ** 2, good) / n)
        ma, mb = mean(a), mean(b)
        return n.astype(float), mean(p - t), ma, spread(a, ma), mb, spread(b, mb)

    names = ["n", "gap", "ma", "sa", "mb", "sb"]
    score = _field_sums(names, h, w, kernel)
    rows = pairs.select(*keys, score(pred, truth, clim).alias("_f")).select(*keys, "_f.*")
    part = lambda which, m, s: F.struct(F.lit(which).alias("which"), F.col(m).alias("mean"), F.col(s).alias("std"))
    zero = F.lit(0.0).alias("_zero")
    parts = rows.withColumn("_zero", zero).select(
        *keys, F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("n_null"),
        F.explode(F.array(part("gap", "gap", "_zero"), part("pred", "ma", "sa"), part("truth", "mb", "sb"))).alias("_p"),
    ).select(*keys, "n", "n_null", "_p.*").where("n > 0")
    merged = merge_stats(parts, [*keys, "which"])
    pick = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    scored = merged.groupBy(*keys).agg(
        pick("gap", "mean").alias("bias"), pick("pred", "std").alias("activity_pred"), pick("truth", "std").alias("activity_truth")
    )
    return scored


def _to_pixels(value: Column, peak: float) -> Column:
    """Scale to [0, peak], clamp and round half to even; a missing value stays missing."""
    return F.rint(clamp(present(value) * peak, 0.0, float(peak)))


def pixel_mse(pairs: DataFrame, keys: Sequence[str], peak: float = 255.0, orig: str = "orig",
              recon: str = "recon") -> DataFrame:
    """Mean squared error of values in [0, 1] after conversion to whole pixel values."""
    gap = _to_pixels(F.col(orig), peak) - _to_pixels(F.col(recon), peak)
    return pairs.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))


def psnr(pairs: DataFrame, keys: Sequence[str], peak: float = 255.0, orig: str = "orig",
         recon: str = "recon") -> DataFrame:
    """Peak signal-to-noise ratio of whole pixel values; equal images give infinity."""
    return pixel_mse(pairs, keys, peak, orig, recon).withColumn("psnr", psnr_from_mse(F.col("mse"), peak))


def sequence_psnr(frames: DataFrame, keys: Sequence[str], peak: float = 255.0) -> DataFrame:
    """The two averages over frames, from one ``mse`` per frame.

    ``mean_of_psnr`` averages the frames' PSNR; ``psnr_of_mean`` is the PSNR of their
    mean error.
    """
    return frames.groupBy(*keys).agg(
        F.avg(psnr_from_mse(F.col("mse"), peak)).alias("mean_of_psnr"), F.avg("mse").alias("_m")
    ).select(*keys, "mean_of_psnr", psnr_from_mse(F.col("_m"), peak).alias("psnr_of_mean"))


def psnr_yuv(planes: DataFrame, keys: Sequence[str], plane: str = "plane", value: str = "psnr") -> DataFrame:
    """``(4*y + u + v) / 6``; NULL when a plane is missing."""
    of = lambda p: F.max(F.when(F.col(plane) == p, F.col(value)))
    return planes.groupBy(*keys).agg(((4.0 * of("y") + of("u") + of("v")) / 6.0).alias("psnr_yuv"))


def sweep_worklist(files: DataFrame, qualities: Sequence[int]) -> DataFrame:
    """Every file at every quality."""
    return files.withColumn("qp", F.explode(F.array(*[F.lit(int(q)) for q in qualities])))


def sweep_average(runs: DataFrame, files: DataFrame, item: str = "item",
                  keys: Sequence[str] = ("codec", "qp", "metric")) -> DataFrame:
    """Per (codec, quality, metric) the sum over files divided by the number of files.

    The divisor is the size of the file set, also where a file lacks the metric; runs of
    files outside the set do not count.
    """
    count = files.agg(F.count_distinct(item).alias("_f"))
    runs = runs.join(files.select(item), item, "left_semi")
    sums = runs.groupBy(*keys).agg(F.sum(present("value")).alias("_v"))
    return sums.withColumn("value", F.col("_v") / count.scalar()).drop("_v")


def aggregate_results(runs: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Unweighted mean per metric over per-item results."""
    return runs.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def pending_runs(work: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """The work whose result does not exist yet; everything when forced."""
    return work if force else work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def closest_quality(runs: DataFrame, target: float, keys: Sequence[str], qp: str = "qp",
                    metric: str = "value") -> DataFrame:
    """Per item the quality whose metric is nearest the target, smallest on ties.

    All qualities are compared, so the metric need not be monotone.  One aggregate with
    a mergeable minimum, no sort.
    """
    best = F.min(F.struct(F.abs(F.col(metric) - target).alias("gap"), F.col(qp), F.col(metric)))
    return (
        runs.where(F.col(metric).isNotNull())
        .groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, F.col(f"_b.{qp}").alias(qp), F.col(f"_b.{metric}").alias(metric), F.col("_b.gap").alias("gap"))
    )


def rd_curve(points: DataFrame, codec: str = "codec", x: str = "bpp", y: str = "psnr") -> DataFrame:
    """Each codec's points ordered by rate, as two parallel arrays.

    Points are sweep averages: one per codec and quality.
    """
    return points.groupBy(codec).agg(F.sort_array(F.collect_list(F.struct(x, y))).alias("_p")).select(
        codec, F.col(f"_p.{x}").alias("xs"), F.col(f"_p.{y}").alias("ys")
    )


def timing_summary(timings: DataFrame, keys: Sequence[str], value: str = "seconds") -> DataFrame:
    """Mean and population standard deviation of timings."""
    return timings.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
