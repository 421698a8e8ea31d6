"""The per-cell operators on packed fields: the results of the queries on cells, without a row per cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels as kn
from ..operators.layout import field_to_cells
from ..sizing import reused
from . import core_queries, entropy_queries, gap_queries  # noqa: F401  (their SQL twins are shared)
from . import views as v
from .registry import ORACLES, query, r6

KEYS = ["sample", "c"]
CELL = ["sample", "c", "i", "j"]


def _stats(spark, sf):
    return reused(kn.field_stats(v.latent_fields(spark, sf), ["c"]))


def _scaled(spark, sf):
    """Latents and the mean of their channel, both in twentieths."""
    means = _stats(spark, sf).select("c", (F.col("mean") * 20.0).alias("mean"))
    return _times(v.latent_fields(spark, sf), 20.0).join(means, "c")


def _times(fields, by):
    return fields.withColumn("values", F.transform("values", lambda y: y * by))


def _scales():
    """A scale per cell that grows with its grid row."""
    return F.transform("values", lambda _, k: 0.05 + 1.5 * F.floor(k / F.col("w")))


def _cells(fields, name, rounded=True):
    cells = field_to_cells(fields, KEYS, name)
    return cells.select(*CELL, r6(name).alias(name) if rounded else name)


def _moments(stats):
    return stats.select("c", "n", r6("mean").alias("mean"), r6("std").alias("std"), "n_null")


@query("n01_field_stats", ORACLES["n01_channel_stats"])
def n01(spark, sf):
    return _moments(kn.field_stats(v.latent_fields(spark, sf), ["c"]))


@query("n01_field_stats_gaps", ORACLES["n01_channel_stats_gaps"])
def n01_gaps(spark, sf):
    return _moments(kn.field_stats(gap_queries._fields(spark, sf), ["c"]))


@query("n04_standardize_fields", ORACLES["n04_standardize"])
def n04(spark, sf):
    return _cells(kn.standardize_fields(v.latent_fields(spark, sf), _stats(spark, sf), "c"), "y")


@query("n04_standardize_fields_unknown", ORACLES["n04_standardize_unknown"])
def n04_unknown(spark, sf):
    """One channel has no statistics: its cells stay, without a value."""
    fields = gap_queries._fields(spark, sf)
    return _cells(kn.standardize_fields(fields, kn.field_stats(fields.where("c < 3"), ["c"]), "c"), "y")


@query("n05_destandardize_fields", ORACLES["n05_destandardize"])
def n05(spark, sf):
    return _cells(kn.destandardize_fields(v.latent_fields(spark, sf), _stats(spark, sf), "c"), "y")


@query("q01_quantize_dequantize_fields", ORACLES["q01_quantize_dequantize"])
def q01(spark, sf):
    fields = _scaled(spark, sf)
    return _cells(fields.withColumn("values", kn.quantize_dequantize_fields("values", "mean")), "y_hat")


@query("q02_quantize_symbols_fields", ORACLES["q02_quantize_symbols"])
def q02(spark, sf):
    fields = _scaled(spark, sf)
    return _cells(fields.withColumn("values", kn.quantize_symbols_fields("values", "mean")), "sym", rounded=False)


@query("q03_dequantize_fields", ORACLES["q03_dequantize"])
def q03(spark, sf):
    fields = _scaled(spark, sf).withColumn("values", kn.quantize_symbols_fields("values", "mean"))
    return _cells(fields.withColumn("values", kn.dequantize_fields("values", "mean")), "y_hat")


@query("q05_scale_index_fields", ORACLES["q05_scale_index"])
def q05(spark, sf):
    scales = F.transform("values", lambda y: F.exp(y * 20.0))
    return _cells(v.latent_fields(spark, sf).withColumn("values", kn.scale_index_fields(scales)), "idx", rounded=False)


@query("q05_scale_index_fields_gaps", ORACLES["q05_scale_index_gaps"])
def q05_gaps(spark, sf):
    scales = F.transform("values", lambda y: F.exp(y * 20.0))
    return _cells(gap_queries._fields(spark, sf).withColumn("values", kn.scale_index_fields(scales)), "idx", rounded=False)


def _likelihoods(fields, mean=0.0):
    return _cells(fields.withColumn("values", kn.likelihood_fields("values", _scales(), mean)), "likelihood")


@query("e14_likelihood_fields", ORACLES["e14_gaussian_likelihood"])
def e14(spark, sf):
    return _likelihoods(_scaled(spark, sf), "mean")


@query("e14_likelihood_fields_gaps", ORACLES["e14_gaussian_likelihood_gaps"])
def e14_gaps(spark, sf):
    return _likelihoods(_times(gap_queries._fields(spark, sf), 20.0))


def _bits(fields, mean=0.0):
    return kn.bits_from_fields(fields.withColumn("scales", _scales()), 16, mean=mean)


@query("e15_bits_from_fields", ORACLES["e15_bits_from_likelihood"])
def e15(spark, sf):
    out = _bits(_scaled(spark, sf), "mean")
    return out.select("sample", F.round("bits", 3).alias("bits"), F.round("bpp", 4).alias("bpp"), "n_null")


@query("e15_bits_from_fields_gaps", ORACLES["e15_bits_from_likelihood_gaps"])
def e15_gaps(spark, sf):
    out = _bits(_times(gap_queries._fields(spark, sf), 20.0))
    return out.select("sample", F.round("bits", 3).alias("bits"), "n_null")
