"""End-to-end plans: what normalising and quantising costs, and what it loses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quantise as qz
from ..operators import scoring as sc
from ..operators import statistics as st
from ..sizing import reused
from . import views as v
from .registry import q6, query, r6

STEP = 0.25


@query(
    "flagship_reconstruction_error",
    f"""{v.with_views("latent")},
stats AS (SELECT c, avg(y) AS mean, stddev_pop(y) AS std FROM latent GROUP BY c),
rec AS (SELECT c, y, (round_even((y - mean) / std / CAST({STEP} AS DOUBLE), 0) * CAST({STEP} AS DOUBLE)) * std + mean AS y_hat
        FROM latent JOIN stats USING (c))
SELECT c, {q6("sqrt(avg((y - y_hat) * (y - y_hat)))")} AS rmse, {q6("avg(abs(y - y_hat))")} AS mae,
 {q6("max(abs(y - y_hat))")} AS max_error, count(*) AS n FROM rec GROUP BY c""",
)
def reconstruction_error(spark: SparkSession, sf: str) -> DataFrame:
    """Standardise, quantise at a quarter of a deviation, undo both, score per channel.

    The statistics are one small table, broadcast after a size check, so the cells are
    read, transformed and aggregated in one stage without being shuffled.
    """
    cells = v.latent(spark, sf).withColumn("orig", F.col("y"))
    stats = reused(st.channel_stats(cells, ["c"], "y"))
    scaled = st.standardize(cells, stats, "channel", channel="c", value="y")
    coded = scaled.withColumn("y", qz.quantize_dequantize(F.col("y") / STEP) * STEP)
    back = st.destandardize(coded, stats, channel="c", value="y").withColumnRenamed("y", "recon")
    table = sc.channel_error_table(back, ["c"])
    return table.select(
        "c", r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("max_error").alias("max_error"), "n"
    )
