import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.numeric import clamp, human_size, log_table, psnr_from_mse, ratio_to_db, size_in, with_erfc
from fieldloom.operators import quantise as qz
from fieldloom.operators.likelihood import gaussian_likelihood


def erfc_library(x):
    """The C library's erfc, to check the column expression against."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(math.erfc)

    return run(x)


def test_erfc_matches_library(spark):
    xs = [float(x) for x in np.concatenate([np.linspace(-7, 26, 3001), [0.46875, 4.0, -0.46875, -4.0, 0.0]])]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    both = with_erfc(df, {"a": F.col("x")}).withColumn("b", erfc_library(F.col("x")))
    assert both.columns == ["x", "a", "b"]
    for r in both.collect():
        assert r.b == math.erfc(r.x)
        assert r.a == pytest.approx(r.b, rel=2e-13, abs=1e-300)
    assert with_erfc(df.limit(1), {"a": F.lit(None).cast("double")}).first().a is None


def test_gaussian_likelihood(spark):
    rng = np.random.default_rng(1)
    rows = [(float(y), float(s)) for y, s in zip(rng.normal(0, 4, 500), rng.uniform(0.01, 8, 500))]
    df = spark.createDataFrame(rows, "y double, s double")
    for r in gaussian_likelihood(df.withColumn("m", F.lit(0.3)), scale="s", mean="m", out="p").collect():
        s, v = max(r.s, 0.11), abs(r.y - 0.3)
        phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
        assert r.p == pytest.approx(max(phi((0.5 - v) / s) - phi((-0.5 - v) / s), 1e-9), abs=1e-12)


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, 0.5, 1.5, 2.5)], "y double")
    out = df.select(qz.quantize_symbols(F.col("y")).alias("q"), qz.quantize_dequantize(F.col("y")).alias("d")).collect()
    assert [r.q for r in out] == [0, 0, 2, 2]
    assert [math.copysign(1, r.d) for r in out] == [1, 1, 1, 1]


def test_scale_index_is_the_count_of_smaller_entries(spark):
    table = log_table(0.11, 256.0, 64)
    near = [t * f for t in table for f in (1 - 1e-12, 1.0, 1 + 1e-12)]
    values = near + [1e-9, 0.11, 0.12, 255.9, 256.0, 1e6]
    df = spark.createDataFrame([(float(s),) for s in values], "s double")
    for r in df.select("s", qz.scale_index(F.col("s")).alias("k")).collect():
        assert r.k == sum(t < max(r.s, 0.11) for t in table[:-1])


def test_quantisation_error_is_at_most_half_a_step(spark):
    df = spark.range(1000).select((F.rand(3) * 40 - 20).alias("y"), F.rand(4).alias("m"))
    gap = F.abs(qz.quantize_dequantize(F.col("y"), F.col("m")) - F.col("y"))
    assert df.agg(F.max(gap)).first()[0] <= 0.5 + 1e-12


def test_noise_is_a_function_of_the_key(spark):
    df = spark.range(2000).withColumn("y", F.lit(1.0))
    a = df.select("id", qz.quantize_noise(F.col("y"), 5, ["id"]).alias("n"))
    b = df.repartition(7).select("id", qz.quantize_noise(F.col("y"), 5, ["id"]).alias("n"))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    lo, hi, mean = a.agg(F.min("n"), F.max("n"), F.avg("n")).first()
    assert 0.5 <= lo < hi < 1.5 and abs(mean - 1.0) < 0.05


def test_human_size(spark):
    want = {0: "0", 1: "1", 1023: "1023", 1024: "1K", 1536: "1.5K", 10**6: "976.6K", 2**30: "1G", 5 * 2**50: "5P"}
    df = spark.createDataFrame([(k,) for k in want], "n bigint")
    assert {r.n: r.t for r in df.select("n", human_size(F.col("n")).alias("t")).collect()} == want
    assert df.where("n = 1024").select(size_in(F.col("n"), "KB")).first()[0] == 1.0
    with pytest.raises(ValueError):
        size_in(F.col("n"), "TB")


def test_infinite_scores(spark):
    df = spark.range(1)
    assert df.select(psnr_from_mse(F.lit(0.0), 255.0)).first()[0] == math.inf
    assert df.select(ratio_to_db(F.lit(1.0))).first()[0] == math.inf
    assert df.select(ratio_to_db(F.lit(0.99))).first()[0] == pytest.approx(20.0)


def test_clamp_keeps_missing_values(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "x double")
    assert [r.y for r in df.select(clamp(F.col("x"), 0.0, 1.0).alias("y")).collect()] == [None, 0.0, 0.5, 1.0]
    assert [r.y for r in df.select(clamp(F.col("x"), high=1.0).alias("y")).collect()] == [None, -1.0, 0.5, 1.0]
