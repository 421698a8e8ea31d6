"""M rows on the shared tables (the forecast scores are with the time rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import scoring as sc
from . import views as v
from .registry import q6, query, r6
from .views import with_views

RECON = with_views("latent", "recon")
RUNS = with_views("runs")
METRICS = with_views("runs", "metric_runs")


def _pairs(spark, sf):
    return ch.pair_fields(v.latent_fields(spark, sf), v.recon_fields(spark, sf), ["sample", "c"])


@query(
    "m01_channel_error_table",
    f"""{RECON} SELECT c, {q6("sqrt(avg((orig - recon) * (orig - recon)))")} AS rmse, {q6("avg(abs(orig - recon))")} AS mae,
 {q6("max(abs(orig - recon))")} AS max_error, count(*) AS n, CAST(0 AS BIGINT) AS n_null FROM recon GROUP BY c""",
)
def m01(spark, sf):
    out = sc.channel_error_table(_pairs(spark, sf), ["c"])
    return out.select("c", *[r6(x).alias(x) for x in ("rmse", "mae", "max_error")], "n", "n_null")


@query(
    "m02_mse",
    f"""{RECON} SELECT sample, c, round(avg((orig - recon) * (orig - recon)), 9) AS mse FROM recon GROUP BY ALL""",
)
def m02(spark, sf):
    return sc.mse(_pairs(spark, sf), ["sample", "c"]).select("sample", "c", F.round("mse", 9).alias("mse"))


# Pixels: latents moved into [0, 1].
PIXELS = """px AS (SELECT sample, c, i, j, round_even(least(greatest((orig + 0.5) * 255, 0), 255), 0) AS a,
 round_even(least(greatest((recon + 0.5) * 255, 0), 255), 0) AS b FROM recon),
frames AS (SELECT sample, c, avg((a - b) * (a - b)) AS mse FROM px GROUP BY ALL)"""
PSNR = "CASE WHEN {m} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 20 * log10(CAST(255 AS DOUBLE)) - 10 * log10({m}) END"


def _frames(spark, sf):
    moved = _pairs(spark, sf).withColumns({"orig": F.col("orig") + 0.5, "recon": F.col("recon") + 0.5})
    return sc.psnr(moved, ["sample", "c"])


@query("m06_psnr", f"{RECON}, {PIXELS} SELECT sample, c, {q6('mse')} AS mse, {q6(PSNR.format(m='mse'))} AS psnr FROM frames")
def m06(spark, sf):
    return _frames(spark, sf).select("sample", "c", r6("mse").alias("mse"), r6("psnr").alias("psnr"))


@query(
    "m07_sequence_psnr",
    f"""{RECON}, {PIXELS}, s AS (SELECT c, avg({PSNR.format(m="mse")}) AS mean_of_psnr, avg(mse) AS m FROM frames GROUP BY c)
SELECT c, {q6("mean_of_psnr")} AS mean_of_psnr, {q6(PSNR.format(m="m"))} AS psnr_of_mean FROM s""",
)
def m07(spark, sf):
    out = sc.sequence_psnr(_frames(spark, sf), ["c"])
    return out.select("c", r6("mean_of_psnr").alias("mean_of_psnr"), r6("psnr_of_mean").alias("psnr_of_mean"))


@query(
    "m08_psnr_yuv",
    f"""{RUNS} SELECT item, qp, {q6("(4 * max(CASE WHEN codec = 'A' THEN psnr END) + max(CASE WHEN codec = 'N' THEN psnr END) + max(CASE WHEN codec = 'R' THEN psnr END)) / 6")} AS psnr_yuv
FROM runs GROUP BY ALL""",
)
def m08(spark, sf):
    c = F.col("codec")
    planes = v.runs(spark, sf).withColumn("plane", F.when(c == "A", "y").when(c == "N", "u").otherwise("v"))
    return sc.psnr_yuv(planes, ["item", "qp"]).select("item", "qp", r6("psnr_yuv").alias("psnr_yuv"))


@query(
    "m09_ratio_to_db",
    f"""{RUNS} SELECT codec, qp, item, {q6("CASE WHEN psnr / 50 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE -10 * log10(1 - psnr / 50) END")} AS db FROM runs""",
)
def m09(spark, sf):
    return v.runs(spark, sf).select(
        "codec", "qp", "item", r6(sc.ratio_to_db(F.col("psnr") / 50)).alias("db")
    )


@query(
    "m10_sweep_worklist",
    """SELECT s_suppkey AS item, qp FROM supplier, (SELECT unnest([1, 3, 5])::INTEGER AS qp)""",
)
def m10_work(spark, sf):
    return sc.sweep_worklist(v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item")), [1, 3, 5])


@query(
    "m10_sweep_average",
    f"""{METRICS} SELECT codec, qp, metric, {q6("sum(value) / (SELECT count(*) FROM supplier)")} AS value FROM metric_runs GROUP BY ALL""",
)
def m10(spark, sf):
    files = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item"))
    out = sc.sweep_average(v.metric_runs(spark, sf), files)
    return out.select("codec", "qp", "metric", r6("value").alias("value"))


@query("m11_aggregate_results", f"{METRICS} SELECT codec, metric, {q6('avg(value)')} AS value, count(value) AS n FROM metric_runs GROUP BY ALL")
def m11(spark, sf):
    out = sc.aggregate_results(v.metric_runs(spark, sf), ["codec", "metric"])
    return out.select("codec", "metric", r6("value").alias("value"), "n")


PENDING = f"""{RUNS}, work AS (SELECT s_suppkey AS item, qp FROM supplier, (SELECT unnest([1, 3, 5])::INTEGER AS qp))"""


@query(
    "m12_pending_runs",
    f"""{PENDING} SELECT item, qp FROM work w
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.item = w.item AND r.qp = w.qp AND codec = 'A' AND psnr > 25)""",
)
def m12(spark, sf):
    done = v.runs(spark, sf).where("codec = 'A' AND psnr > 25")
    return sc.pending_runs(m10_work(spark, sf), done, ["item", "qp"])


@query(
    "m13_closest_quality",
    f"""{RUNS} SELECT codec, item, qp, {q6("psnr")} AS psnr, {q6("abs(psnr - 25)")} AS gap FROM runs
QUALIFY row_number() OVER (PARTITION BY codec, item ORDER BY abs(psnr - 25), qp) = 1""",
)
def m13(spark, sf):
    out = sc.closest_quality(v.runs(spark, sf), 25.0, ["codec", "item"], metric="psnr")
    return out.select("codec", "item", "qp", r6("psnr").alias("psnr"), r6("gap").alias("gap"))


def _text(name):
    return F.array_join(F.transform(name, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias(name)


@query(
    "m14_rd_curve",
    f"""{RUNS}, p AS (SELECT codec, qp, avg(bpp) AS x, avg(psnr) AS y FROM runs GROUP BY ALL)
SELECT codec, string_agg(CAST(CAST(round(x * CAST(1000000 AS DOUBLE)) AS BIGINT) AS VARCHAR), ',' ORDER BY x) AS xs,
 string_agg(CAST(CAST(round(y * CAST(1000000 AS DOUBLE)) AS BIGINT) AS VARCHAR), ',' ORDER BY x) AS ys FROM p GROUP BY codec""",
)
def m14(spark, sf):
    points = v.runs(spark, sf).groupBy("codec", "qp").agg(F.avg("bpp").alias("bpp"), F.avg("psnr").alias("psnr"))
    return sc.rd_curve(points).select("codec", _text("xs"), _text("ys"))


@query(
    "m15_timing_summary",
    f"""SELECT event_type, {q6("avg(value)")} AS mean, {q6("stddev_pop(value)")} AS std FROM events GROUP BY 1""",
)
def m15(spark, sf):
    out = sc.timing_summary(v.table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", r6("mean").alias("mean"), r6("std").alias("std"))
