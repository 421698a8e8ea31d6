"""Gaussian likelihoods, rate, distortion and divergence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, present, with_erfc
from .quantise import SCALE_BOUND

# Fixed value: no likelihood is taken to be smaller than this.
LIKELIHOOD_BOUND = 1e-9


def gaussian_likelihood(cells: DataFrame, y: str = "y", scale: str = "scale", mean: str | None = None,
                        out: str = "likelihood") -> DataFrame:
    """Add the probability of the unit-wide bin around ``y`` under a Gaussian.

    The scale is at least 0.11 and the result at least 1e-9; a missing latent, scale or mean
    gives NULL.
    """
    centre = present(y) if mean is None else present(y) - present(mean)
    ready = cells.withColumns(
        {"_v": F.abs(centre), "_s": clamp(present(scale), SCALE_BOUND) * math.sqrt(2.0)}
    )
    tails = with_erfc(
        ready, {"_up": (F.col("_v") - 0.5) / F.col("_s"), "_low": (F.col("_v") + 0.5) / F.col("_s")}
    )
    share = clamp(0.5 * F.col("_up") - 0.5 * F.col("_low"), LIKELIHOOD_BOUND)
    return tails.withColumn(out, share).drop("_v", "_s", "_up", "_low")


def bits_from_likelihood(cells: DataFrame, pixels: int, keys: Sequence[str] = ("sample",),
                         likelihood: str = "likelihood") -> DataFrame:
    """Total bits and bits per pixel of a sample, summed over all its latents.

    Latents without a likelihood cannot be priced; ``n_null`` counts them.
    """
    known = present(likelihood)
    bits = -F.sum(F.log(known)) / math.log(2.0)
    missing = F.count(F.lit(1)) - F.count(known)
    return cells.groupBy(*keys).agg(bits.alias("bits"), missing.alias("n_null")).withColumn(
        "bpp", F.col("bits") / pixels
    )


def rate_distortion(bits: DataFrame, errors: DataFrame, lmbda: float = 0.01, bpp_weight: float = 0.01,
                    keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Weighted rate and weighted distortion, side by side per sample.

    ``bits`` has ``bpp`` and ``errors`` has ``mse``, both one row per key.
    """
    return bits.join(errors, list(keys)).select(
        *keys,
        (F.col("bpp") * bpp_weight).alias("bpp_loss"),
        (F.col("mse") * lmbda).alias("mse_loss"),
    )


def logvar_distortion(cells: DataFrame, logvars: DataFrame, keys: Sequence[str] = ("sample",),
                      channel: str = "c", orig: str = "orig", recon: str = "recon") -> DataFrame:
    """E16, learned variance: mean of ``se / exp(lv) + lv`` with one ``lv`` per channel."""
    side = logvars.select(channel, F.col("logvar").alias("_lv"))
    gap = present(orig) - present(recon)
    return (
        cells.join(side, channel, "left")
        .groupBy(*keys)
        .agg(F.avg(gap * gap / F.exp("_lv") + F.col("_lv")).alias("mse_loss"))
    )


def gaussian_kl(moments: DataFrame, keys: Sequence[str] = ("sample",), other: bool = False,
                deterministic: bool = False) -> DataFrame:
    """Divergence per sample from the unit Gaussian, a mean over cells.

    With ``other``, the second Gaussian is in ``mean2`` and ``logvar2``.  Cells with a missing
    moment do not count.  A deterministic posterior has no spread, and by definition 0.
    """
    if deterministic:
        return moments.groupBy(*keys).agg(F.lit(0.0).alias("kl"))
    mu, lv = present("mean"), present("logvar")
    var = F.exp(lv)
    if other:
        lv2 = present("logvar2")
        var2 = F.exp(lv2)
        gap = mu - present("mean2")
        term = gap * gap / var2 + var / var2 - 1.0 - lv + lv2
        value = 0.5 * F.avg(term)
    else:
        value = 0.5 * F.avg(mu * mu + var - 1.0 - lv)
    return moments.groupBy(*keys).agg(value.alias("kl"))


def gaussian_nll(moments: DataFrame, sample: str, keys: Sequence[str] = ("sample",),
                 deterministic: bool = False) -> DataFrame:
    """``0.5 * sum(ln 2pi + logvar + (x - mean)^2 / var)`` per sample, over complete cells; 0 by
    definition for a deterministic posterior."""
    if deterministic:
        return moments.groupBy(*keys).agg(F.lit(0.0).alias("nll"))
    gap = present(sample) - present("mean")
    term = math.log(2.0 * math.pi) + present("logvar") + gap * gap / F.exp(present("logvar"))
    return moments.groupBy(*keys).agg((0.5 * F.sum(term)).alias("nll"))


def bits_per_pixel(catalog: DataFrame, channels: int, h: int, w: int, bits: str = "total_bits") -> DataFrame:
    """Bits per pixel (``h*w``) and per sub-pixel (``channels*h*w``)."""
    return catalog.withColumns(
        {"bpp": F.col(bits) / float(h * w), "bpsp": F.col(bits) / float(channels * h * w)}
    )


def bitrate_kbps(seq: DataFrame, size: str = "bytes", fps: str = "fps", frames: str = "frames") -> DataFrame:
    """``bytes * 8 * fps / (frames * 1000)``; no frames gives NULL."""
    rate = F.col(size) * 8 * F.col(fps) / (F.col(frames) * 1000)
    return seq.withColumn("kbps", F.when(F.col(frames) > 0, rate))
