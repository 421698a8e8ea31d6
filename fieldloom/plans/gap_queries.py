"""Operators on data with gaps: NULL and NaN cells never count as values.

Every 17th latent is NULL and every 23rd NaN; every 19th reconstruction is NaN.  The SQL twins
name a missing cell NULL and spell out what becomes of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import entropy as en
from ..operators import likelihood as lk
from ..operators import quantise as qz
from ..operators import scoring as sc
from ..operators import spatial as sp
from ..operators import statistics as st
from ..operators import timeaxis as tx
from ..operators.layout import field_to_cells
from ..streaming import scores as ss
from . import views as v
from .entropy_queries import bits_sql, cdf_sql, erfc_sql
from .registry import q6, qstamp, query, r6, stamp
from .stream_queries import as_wall, event_stream
from .views import with_views

NAN = float("nan")

GAPS = f"""{with_views("latent")},
holes AS (SELECT sample, c, i, j, CASE WHEN n % 17 = 0 OR n % 23 = 0 THEN NULL ELSE y END AS y,
  CASE WHEN n % 19 = 0 THEN NULL ELSE round_even(y * CAST(20 AS DOUBLE), 0) / CAST(20 AS DOUBLE) END AS recon
  FROM (SELECT *, sample * 64 + c * 16 + i * 4 + j AS n FROM latent))"""


def _fields(spark, sf):
    """Packed latents with gaps: ``values`` and their reconstruction ``recon``."""
    fields = v.latent_fields(spark, sf)
    at = lambda k: F.col("sample") * 64 + F.col("c") * 16 + k
    holes = lambda y, k: F.when(at(k) % 17 == 0, None).when(at(k) % 23 == 0, NAN).otherwise(y)
    coded = lambda y, k: F.when(at(k) % 19 == 0, NAN).otherwise(F.rint(y * 20.0) / 20.0)
    return fields.withColumns({"recon": F.transform("values", coded), "values": F.transform("values", holes)})


def _cells(spark, sf):
    return field_to_cells(_fields(spark, sf), ["sample", "c"], "y")


def _pairs(spark, sf):
    fields = _fields(spark, sf)
    right = fields.select("sample", "c", "h", "w", F.col("recon").alias("values"))
    return ch.pair_fields(fields.drop("recon"), right, ["sample", "c"])


# --- statistics -------------------------------------------------------------------------

@query(
    "n01_channel_stats_gaps",
    f"""{GAPS} SELECT c, count(y) AS n, {q6("avg(y)")} AS mean, {q6("stddev_pop(y)")} AS std, count(*) - count(y) AS n_null FROM holes GROUP BY c""",
)
def n01(spark, sf):
    out = st.channel_stats(_cells(spark, sf), ["c"], "y")
    return out.select("c", "n", r6("mean").alias("mean"), r6("std").alias("std"), "n_null")


@query(
    "n03_merge_stats_gaps",
    f"""{GAPS} SELECT c, count(y) AS n, {q6("avg(y)")} AS mean, {q6("stddev_pop(y)")} AS std, count(*) - count(y) AS n_null FROM holes GROUP BY c""",
)
def n03(spark, sf):
    parts = st.channel_stats(_cells(spark, sf), ["sample", "c"], "y")
    out = st.merge_stats(parts, ["c"])
    return out.select("c", "n", r6("mean").alias("mean"), r6("std").alias("std"), "n_null")


@query(
    "n04_standardize_unknown",
    f"""{GAPS}, stats AS (SELECT c, avg(y) AS mean, stddev_pop(y) AS std FROM holes WHERE c < 3 GROUP BY c)
SELECT sample, holes.c, i, j, {q6("(y - mean) / std")} AS y FROM holes LEFT JOIN stats USING (c)""",
)
def n04(spark, sf):
    """One channel has no statistics: its cells stay, without a value."""
    cells = _cells(spark, sf)
    stats = st.channel_stats(cells.where("c < 3"), ["c"], "y")
    out = st.standardize(cells.withColumn("y", st.present("y")), stats, channel="c", value="y")
    return out.select("sample", "c", "i", "j", r6("y").alias("y"))


@query(
    "n06_minmax_quantize_gaps",
    f"""{GAPS}, m AS (SELECT sample, c, min(y) AS shift, max(y) - min(y) AS scale FROM holes GROUP BY ALL)
SELECT sample, c, i, j, CAST(CASE WHEN y IS NULL THEN NULL WHEN scale > 0 THEN floor((y - shift) / scale * 65535) ELSE 0 END AS INTEGER) AS code,
 {q6("shift")} AS shift, {q6("scale")} AS scale FROM holes JOIN m USING (sample, c)""",
)
def n06(spark, sf):
    stored = st.minmax_quantize(_fields(spark, sf))
    cells = field_to_cells(stored, ["sample", "c", "shift", "scale"], "code")
    return cells.select("sample", "c", "i", "j", "code", r6("shift").alias("shift"), r6("scale").alias("scale"))


@query(
    "n09_latent_channel_means_gaps",
    f"""{GAPS}, s AS (SELECT sample, c, avg(y) AS m FROM holes GROUP BY ALL) SELECT c, {q6("avg(m)")} AS mean FROM s GROUP BY c""",
)
def n09(spark, sf):
    return st.latent_channel_means(_fields(spark, sf)).select("c", r6("mean").alias("mean"))


@query(
    "q05_scale_index_gaps",
    f"""{GAPS},
t AS (SELECT k, exp(ln(CAST(0.11 AS DOUBLE)) + (ln(CAST(256 AS DOUBLE)) - ln(CAST(0.11 AS DOUBLE))) * k / CAST(63 AS DOUBLE)) AS bound
      FROM range(0, 63) r(k))
SELECT sample, c, i, j, CASE WHEN y IS NULL THEN NULL ELSE
 CAST((SELECT count(*) FROM t WHERE t.bound < greatest(exp(y * CAST(20 AS DOUBLE)), CAST(0.11 AS DOUBLE))) AS INTEGER) END AS idx FROM holes""",
)
def q05(spark, sf):
    return _cells(spark, sf).select("sample", "c", "i", "j", qz.scale_index(F.exp(F.col("y") * 20.0)).alias("idx"))


@query(
    "c09_split_moments_gaps",
    f"""{GAPS}, m AS (SELECT a.sample, a.c, a.i, a.j, a.y AS mean,
  CASE WHEN b.y IS NULL THEN NULL ELSE least(greatest(b.y, CAST(-30 AS DOUBLE)), CAST(20 AS DOUBLE)) END AS logvar
  FROM holes a JOIN holes b ON a.sample = b.sample AND b.c = a.c + 2 AND a.i = b.i AND a.j = b.j WHERE a.c < 2)
SELECT sample, c, i, j, {q6("mean")} AS mean, {q6("logvar")} AS logvar, {q6("exp(logvar)")} AS var FROM m""",
)
def c09(spark, sf):
    cells = _cells(spark, sf).withColumn("y", st.present("y"))
    out = ch.split_moments(cells, 2)
    return out.select("sample", "c", "i", "j", r6("mean").alias("mean"), r6("logvar").alias("logvar"), r6("var").alias("var"))


MOMENTS = f"""{GAPS}, m AS (SELECT a.sample, a.c, a.i, a.j, a.y AS mean, b.y AS logvar
  FROM holes a JOIN holes b ON a.sample = b.sample AND b.c = a.c + 2 AND a.i = b.i AND a.j = b.j WHERE a.c < 2)"""


def _moments(spark, sf):
    return ch.split_moments(_cells(spark, sf), 2)


@query(
    "e17_gaussian_kl_gaps",
    f"""{MOMENTS} SELECT sample, {q6("0.5 * avg(CASE WHEN mean IS NULL OR logvar IS NULL THEN NULL ELSE mean * mean + exp(logvar) - 1 - logvar END)")} AS kl
FROM m GROUP BY sample""",
)
def e17(spark, sf):
    return lk.gaussian_kl(_moments(spark, sf)).select("sample", r6("kl").alias("kl"))


@query(
    "e18_gaussian_nll_gaps",
    f"""{MOMENTS} SELECT sample, {q6("0.5 * sum(CASE WHEN mean IS NULL OR logvar IS NULL THEN NULL ELSE ln(2 * pi()) + logvar + (0.05 * i - mean) * (0.05 * i - mean) / exp(logvar) END)")} AS nll
FROM m GROUP BY sample""",
)
def e18(spark, sf):
    return lk.gaussian_nll(_moments(spark, sf).withColumn("x", 0.05 * F.col("i")), "x").select("sample", r6("nll").alias("nll"))


LIK = f"""{GAPS},
a AS (SELECT sample, c, i, j, (abs(y * 20) - 0.5) / (greatest(0.05 + 1.5 * i, 0.11) * sqrt(2)) AS x1,
  (abs(y * 20) + 0.5) / (greatest(0.05 + 1.5 * i, 0.11) * sqrt(2)) AS x2 FROM holes),
lik AS (SELECT sample, c, i, j, CASE WHEN x1 IS NULL THEN NULL ELSE greatest(0.5 * {erfc_sql("x1")} - 0.5 * {erfc_sql("x2")}, CAST(1e-9 AS DOUBLE)) END AS likelihood FROM a)"""


def _likelihoods(spark, sf):
    cells = _cells(spark, sf).withColumns({"y": F.col("y") * 20.0, "scale": 0.05 + 1.5 * F.col("i")})
    return lk.gaussian_likelihood(cells)


@query("e14_gaussian_likelihood_gaps", f"{LIK} SELECT sample, c, i, j, {q6('likelihood')} AS likelihood FROM lik")
def e14(spark, sf):
    return _likelihoods(spark, sf).select("sample", "c", "i", "j", r6("likelihood").alias("likelihood"))


@query(
    "e15_bits_from_likelihood_gaps",
    f"""{LIK} SELECT sample, round(-sum(log2(likelihood)), 3) AS bits, count(*) - count(likelihood) AS n_null FROM lik GROUP BY 1""",
)
def e15(spark, sf):
    out = lk.bits_from_likelihood(_likelihoods(spark, sf), 16)
    return out.select("sample", F.round("bits", 3).alias("bits"), "n_null")


# --- grids and series -----------------------------------------------------------------

KEYS = ["sample", "c"]


def _shown(fields):
    return field_to_cells(fields, KEYS, "y").select("sample", "c", "i", "j", r6("y").alias("y"))


@query(
    "g05_downsample_avg_gaps",
    f"""{GAPS} SELECT sample, c, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, {q6("avg(y)")} AS y FROM holes GROUP BY ALL""",
)
def g05(spark, sf):
    return _shown(sp.downsample_avg(_fields(spark, sf).drop("recon"), 4, 4))


# The weights of the cells that are present, scaled up to one.
MEAN = "sum(CASE WHEN y IS NULL THEN NULL ELSE y * a.w * b.w END) / nullif(sum(CASE WHEN y IS NULL THEN 0 ELSE a.w * b.w END), 0)"


@query(
    "g07_regrid_bilinear_gaps",
    f"""{GAPS},
ti AS (SELECT t, greatest((t + 0.5) * CAST(4 AS DOUBLE) / 3 - 0.5, 0) AS p FROM range(0, 3) r(t)),
tj AS (SELECT t, greatest((t + 0.5) * CAST(4 AS DOUBLE) / 7 - 0.5, 0) AS p FROM range(0, 7) r(t)),
wi AS (SELECT t, least(floor(p), 3) AS s, 1 - (p - floor(p)) AS w FROM ti UNION ALL SELECT t, least(floor(p) + 1, 3), p - floor(p) FROM ti),
wj AS (SELECT t, least(floor(p), 3) AS s, 1 - (p - floor(p)) AS w FROM tj UNION ALL SELECT t, least(floor(p) + 1, 3), p - floor(p) FROM tj)
SELECT sample, c, CAST(a.t AS INTEGER) AS i, CAST(b.t AS INTEGER) AS j, {q6(MEAN)} AS y
FROM holes JOIN wi a ON a.s = holes.i JOIN wj b ON b.s = holes.j GROUP BY ALL""",
)
def g07(spark, sf):
    return _shown(sp.regrid_bilinear(_fields(spark, sf).drop("recon"), 4, 4, 3, 7))


@query(
    "g08_gaussian_blur_gaps",
    f"""{GAPS}, raw AS (SELECT d, exp(-0.5 * power(d / CAST(0.8 AS DOUBLE), 2)) AS e FROM range(-1, 2) r(d)),
k AS (SELECT d, e / (SELECT sum(e) FROM raw) AS w FROM raw),
t AS (SELECT o, least(greatest(o + d, 0), 3) AS s, sum(w) AS w FROM range(0, 4) x(o), k GROUP BY ALL)
SELECT sample, c, CAST(a.o AS INTEGER) AS i, CAST(b.o AS INTEGER) AS j, {q6(MEAN)} AS y
FROM holes JOIN t a ON a.s = holes.i JOIN t b ON b.s = holes.j GROUP BY ALL""",
)
def g08(spark, sf):
    return _shown(sp.gaussian_blur(_fields(spark, sf).drop("recon"), 4, 4, 3, 0.8))


def _first_cells(spark, sf):
    """One value a sample, some missing, with a sparse order column."""
    first = F.get("values", F.lit(0))
    return _fields(spark, sf).where("c = 0").select((F.col("sample") * 100_003 % 1_000_000_007).alias("seq"), F.lit("x").alias("key"), first.alias("value"))


FIRST = f"""{GAPS}, first_cells AS (SELECT sample * 100003 % 1000000007 AS seq, 'x' AS key, y AS value FROM holes WHERE c = 0 AND i = 0 AND j = 0)"""


@query(
    "n08_cumulative_mse_gaps",
    f"""{FIRST} SELECT seq, round(coalesce(avg(value * value) OVER (ORDER BY seq), 0), 9) AS running_mse FROM first_cells""",
)
def n08(spark, sf):
    files = _first_cells(spark, sf).withColumn("mse", F.col("value") * F.col("value"))
    return st.cumulative_mse(files, "seq", block=16).select("seq", F.round("running_mse", 9).alias("running_mse"))


@query(
    "n11_ema_gaps",
    f"""{FIRST.replace("WITH ", "WITH RECURSIVE ", 1)},
known AS (SELECT seq, value, row_number() OVER (ORDER BY seq) - 1 AS n FROM first_cells WHERE value IS NOT NULL),
run AS (SELECT seq, n, value AS s FROM known WHERE n = 0
  UNION ALL
  SELECT k.seq, k.n, r.s - (1 - least(CAST(0.99 AS DOUBLE), CAST(1 + k.n AS DOUBLE) / CAST(10 + k.n AS DOUBLE))) * (r.s - k.value)
  FROM run r JOIN known k ON k.n = r.n + 1)
SELECT f.seq, {q6("last_value(r.s IGNORE NULLS) OVER (ORDER BY f.seq)")} AS ema FROM first_cells f LEFT JOIN run r ON r.seq = f.seq""",
)
def n11(spark, sf):
    return st.ema(_first_cells(spark, sf), 0.99, block=32).select("seq", r6("ema").alias("ema"))


SYMBOL_GAPS = f"""{GAPS}, symbols AS (SELECT sample, c, i, j, CAST(round_even(y * CAST(20 AS DOUBLE), 0) AS INTEGER) AS sym FROM holes),
hist AS (SELECT c, sym, count(*) AS n FROM symbols WHERE sym IS NOT NULL GROUP BY ALL),
support AS (SELECT c, min(sym) - 1 AS lo, max(sym) + 1 AS hi FROM symbols GROUP BY c)"""


def _symbols(spark, sf):
    return _cells(spark, sf).select("sample", "c", "i", "j", qz.quantize_symbols(F.col("y") * 20.0).alias("sym"))


@query("e02_symbol_cdf_gaps", f"{SYMBOL_GAPS}, {cdf_sql('cdf', 'c', 'hist', '(SELECT c FROM support)')} SELECT c, k, sym, cproba, step FROM cdf")
def e02(spark, sf):
    return en.symbol_cdf(en.symbol_histogram(_symbols(spark, sf)))


@query(
    "e06_context_cdf_gaps",
    f"""{SYMBOL_GAPS}, ctx_hist AS (SELECT c, CAST(i % 3 AS INTEGER) AS ctx, sym, count(*) AS n FROM symbols WHERE sym IS NOT NULL GROUP BY ALL),
{cdf_sql('ctx_cdf', 'c, ctx', 'ctx_hist', '(SELECT c, unnest([0, 1, 2]) AS ctx FROM support)')} SELECT c, ctx, k, sym, cproba, step FROM ctx_cdf""",
)
def e06(spark, sf):
    return en.context_cdf(en.context_histogram(_symbols(spark, sf).withColumn("ctx", F.col("i") % 3)))


@query(
    "e04_cross_entropy_gaps",
    f"""{SYMBOL_GAPS}, {cdf_sql('cdf', 'c', 'hist', '(SELECT c FROM support)')}, {bits_sql('b', 'hist', 'cdf', 'c', 'c')},
lost AS (SELECT c, count(*) - count(sym) AS n_unpriced FROM symbols GROUP BY c)
SELECT c, {q6("bits")} AS bits, n, n_unpriced FROM b JOIN lost USING (c)""",
)
def e04(spark, sf):
    hist = en.symbol_histogram(_symbols(spark, sf))
    return en.cross_entropy(hist, en.symbol_cdf(hist)).select("c", r6("bits").alias("bits"), "n", "n_unpriced")


@query(
    "q02_quantize_symbols_gaps",
    f"""{GAPS}, big AS (SELECT sample, c, i, j, CASE WHEN sample % 7 = 0 THEN y * 1e12 ELSE y * 20 END AS y FROM holes)
SELECT sample, c, i, j, CASE WHEN abs(round_even(y, 0)) < 2147483648 THEN CAST(round_even(y, 0) AS INTEGER) END AS sym,
 abs(round_even(y, 0)) < 2147483648 AS fits FROM big""",
)
def q02(spark, sf):
    y = F.when(F.col("sample") % 7 == 0, F.col("y") * 1e12).otherwise(F.col("y") * 20.0)
    return _cells(spark, sf).select("sample", "c", "i", "j", qz.quantize_symbols(y).alias("sym"), qz.fits_symbol(y).alias("fits"))


# --- scores -----------------------------------------------------------------------------

@query(
    "m01_channel_error_table_gaps",
    f"""{GAPS} SELECT c, {q6("sqrt(avg((y - recon) * (y - recon)))")} AS rmse, {q6("avg(abs(y - recon))")} AS mae,
 {q6("max(abs(y - recon))")} AS max_error, count(y - recon) AS n, count(*) - count(y - recon) AS n_null FROM holes GROUP BY c""",
)
def m01(spark, sf):
    out = sc.channel_error_table(_pairs(spark, sf), ["c"])
    return out.select("c", *[r6(x).alias(x) for x in ("rmse", "mae", "max_error")], "n", "n_null")


def _pixel(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE round_even(least(greatest(({x} + 0.5) * 255, 0), 255), 0) END"


FRAMES = f"""{GAPS}, px AS (SELECT sample, c, {_pixel("y")} AS a, {_pixel("recon")} AS b FROM holes),
frames AS (SELECT sample, c, avg((a - b) * (a - b)) AS mse FROM px GROUP BY ALL)"""
PSNR = "CASE WHEN {m} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 20 * log10(CAST(255 AS DOUBLE)) - 10 * log10({m}) END"


def _frames(spark, sf):
    moved = _pairs(spark, sf).withColumns({"orig": F.col("orig") + 0.5, "recon": F.col("recon") + 0.5})
    return sc.psnr(moved, ["sample", "c"])


@query("m06_psnr_gaps", f"{FRAMES} SELECT sample, c, {q6('mse')} AS mse, {q6(PSNR.format(m='mse'))} AS psnr FROM frames")
def m06(spark, sf):
    return _frames(spark, sf).select("sample", "c", r6("mse").alias("mse"), r6("psnr").alias("psnr"))


@query(
    "m07_sequence_psnr_gaps",
    f"""{FRAMES}, s AS (SELECT c, avg({PSNR.format(m="mse")}) AS mean_of_psnr, avg(mse) AS m FROM frames GROUP BY c)
SELECT c, {q6("mean_of_psnr")} AS mean_of_psnr, {q6(PSNR.format(m="m"))} AS psnr_of_mean FROM s""",
)
def m07(spark, sf):
    out = sc.sequence_psnr(_frames(spark, sf), ["c"])
    return out.select("c", r6("mean_of_psnr").alias("mean_of_psnr"), r6("psnr_of_mean").alias("psnr_of_mean"))


# Four rows from pole to pole; the reconstruction is the forecast, a slope over the grid the climate.
SCORED = f"""{GAPS},
area AS (SELECT CAST(k AS INTEGER) AS i, CASE WHEN k IN (0, 3) THEN 0 ELSE cos(radians(90 - k * 60)) END AS a FROM range(0, 4) r(k)),
p AS (SELECT sample, c, i, recon AS pred, y AS truth, CAST(0.01 AS DOUBLE) * (i - j) AS clim, a / (SELECT avg(a) FROM area) AS weight
  FROM holes JOIN area USING (i))"""


def _scored(spark, sf):
    clim = 0.01 * (F.col("i") - F.col("j"))
    return _pairs(spark, sf).withColumnsRenamed({"orig": "truth", "recon": "pred"}).withColumn("clim", clim)


def _scored_fields(spark, sf):
    clim = F.array(*[F.lit(0.01 * (k // 4 - k % 4)) for k in range(16)])
    return _fields(spark, sf).withColumnsRenamed({"values": "truth", "recon": "pred"}).withColumn("clim", clim)


@query(
    "m03_weighted_rmse_gaps",
    f"""{SCORED}, t AS (SELECT sample, c, sqrt(sum(weight * (pred - truth) * (pred - truth)) / nullif(sum(CASE WHEN pred IS NULL OR truth IS NULL THEN 0 ELSE weight END), 0)) AS r
  FROM p GROUP BY ALL)
SELECT c, {q6("avg(r)")} AS wrmse, count(r) AS n_times FROM t GROUP BY c""",
)
def m03(spark, sf):
    out = sc.weighted_rmse(_scored(spark, sf), 4, ["c"], time="sample")
    return out.select("c", r6("wrmse").alias("wrmse"), "n_times")


@query(
    "m03_weighted_rmse_fields_gaps",
    f"""{SCORED}, t AS (SELECT sample, c, sqrt(sum(weight * (pred - truth) * (pred - truth)) / nullif(sum(CASE WHEN pred IS NULL OR truth IS NULL THEN 0 ELSE weight END), 0)) AS r
  FROM p GROUP BY ALL)
SELECT c, {q6("avg(r)")} AS wrmse, count(r) AS n_times FROM t GROUP BY c""",
)
def m03_fields(spark, sf):
    out = sc.weighted_rmse_fields(_scored_fields(spark, sf), 4, 4, ["c"])
    return out.select("c", r6("wrmse").alias("wrmse"), "n_times")


@query(
    "m04_anomaly_correlation_gaps",
    f"""{SCORED}, t AS (SELECT sample, c, sum(weight * (pred - clim) * (truth - clim)) AS ab,
  sqrt(sum(weight * (pred - clim) * (pred - clim)) * sum(weight * (truth - clim) * (truth - clim))) AS norm
  FROM p WHERE pred IS NOT NULL AND truth IS NOT NULL GROUP BY ALL)
SELECT c, {q6("avg(CASE WHEN norm > 0 THEN ab / norm END)")} AS acc, count(CASE WHEN norm > 0 THEN 1 END) AS n_times FROM t GROUP BY c""",
)
def m04(spark, sf):
    out = sc.anomaly_correlation(_scored(spark, sf), 4, ["c"], time="sample")
    return out.select("c", r6("acc").alias("acc"), "n_times")


@query(
    "m04_anomaly_correlation_fields_gaps",
    f"""{SCORED}, t AS (SELECT sample, c, sum(weight * (pred - clim) * (truth - clim)) AS ab,
  sqrt(sum(weight * (pred - clim) * (pred - clim)) * sum(weight * (truth - clim) * (truth - clim))) AS norm
  FROM p WHERE pred IS NOT NULL AND truth IS NOT NULL GROUP BY ALL)
SELECT c, {q6("avg(CASE WHEN norm > 0 THEN ab / norm END)")} AS acc, count(CASE WHEN norm > 0 THEN 1 END) AS n_times FROM t GROUP BY c""",
)
def m04_fields(spark, sf):
    out = sc.anomaly_correlation_fields(_scored_fields(spark, sf), 4, 4, ["c"])
    return out.select("c", r6("acc").alias("acc"), "n_times")


@query(
    "m05_bias_activity_gaps",
    f"""{SCORED} SELECT c, {q6("avg(pred - truth)")} AS bias, {q6("stddev_pop(pred - clim)")} AS activity_pred, {q6("stddev_pop(truth - clim)")} AS activity_truth
FROM p WHERE pred IS NOT NULL AND truth IS NOT NULL GROUP BY c""",
)
def m05(spark, sf):
    out = sc.bias_activity(_scored(spark, sf), ["c"])
    return out.select("c", *[r6(x).alias(x) for x in ("bias", "activity_pred", "activity_truth")])


@query(
    "m05_bias_activity_fields_gaps",
    f"""{SCORED} SELECT c, {q6("avg(pred - truth)")} AS bias, {q6("stddev_pop(pred - clim)")} AS activity_pred, {q6("stddev_pop(truth - clim)")} AS activity_truth
FROM p WHERE pred IS NOT NULL AND truth IS NOT NULL GROUP BY c""",
)
def m05_fields(spark, sf):
    out = sc.bias_activity_fields(_scored_fields(spark, sf), 4, 4, ["c"])
    return out.select("c", *[r6(x).alias(x) for x in ("bias", "activity_pred", "activity_truth")])


# --- time -------------------------------------------------------------------------------

HOURS = f"""{with_views("hourly")}, g AS (SELECT ts, channel, CASE WHEN datepart('hour', ts) % 5 = 0 OR datepart('hour', ts) % 7 = 3 THEN NULL ELSE value END AS value FROM hourly)"""


def _hours(spark, sf):
    hour = F.hour("ts")
    value = F.when(hour % 5 == 0, None).when(hour % 7 == 3, NAN).otherwise(F.col("value"))
    return v.hourly(spark, sf).withColumn("value", value)


@query(
    "t07_daily_climatology_gaps",
    f"""{HOURS} SELECT strftime(ts, '%m-%d') AS md, channel, round(avg(value), 4) AS clim FROM g GROUP BY ALL""",
)
def t07(spark, sf):
    return tx.daily_climatology(_hours(spark, sf), 1970, 2100, ["channel"]).select("md", "channel", F.round("clim", 4).alias("clim"))


@query(
    "t08_accumulate_hours_gaps",
    f"""{HOURS}, a AS (SELECT ts, channel, count(value) OVER w AS n, sum(value) OVER w AS s FROM g
  WINDOW w AS (PARTITION BY channel ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
SELECT {qstamp("ts")} AS ts, channel, {q6("CASE WHEN n = 2 THEN s END")} AS accumulated FROM a""",
)
def t08(spark, sf):
    out = tx.accumulate_hours(_hours(spark, sf), 2, ["channel"], chunk_hours=48)
    return out.select(stamp("ts").alias("ts"), "channel", r6("accumulated").alias("accumulated"))


@query(
    "t08_accumulate_fields_gaps",
    f"""{HOURS}, a AS (SELECT ts, channel, count(value) OVER w AS n, sum(value) OVER w AS s FROM g
  WINDOW w AS (PARTITION BY channel ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
SELECT {qstamp("ts")} AS ts, channel, {q6("CASE WHEN n = 2 THEN s END")} AS accumulated FROM a""",
)
def t08_fields(spark, sf):
    fields = _hours(spark, sf).select("ts", "channel", F.array("value").alias("values"))
    out = tx.accumulate_fields(fields, 2, ["channel"], chunk_hours=48)
    return out.select(stamp("ts").alias("ts"), "channel", r6(F.col("accumulated")[0]).alias("accumulated"))


@query(
    "w04_windowed_error_stream_gaps",
    f"""WITH p AS (SELECT ts, event_type, CASE WHEN event_id % 17 = 0 OR event_id % 23 = 0 THEN NULL ELSE value END AS value, round_even(value, 0) AS recon FROM events),
w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type, avg((value - recon) * (value - recon)) AS mse, count(value) AS n
  FROM p GROUP BY ALL)
SELECT {qstamp("s")} AS start, event_type, {q6("mse")} AS mse, n FROM w
WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def w04(spark, sf):
    at = F.col("event_id")
    value = F.when(at % 17 == 0, None).when(at % 23 == 0, NAN).otherwise(F.col("value"))
    pairs = event_stream(spark, sf).withColumns({"orig": value, "recon": F.rint("value")})
    out = ss.drain(ss.windowed_error_stream(pairs, "6 hours", keys=["event_type"]))
    return out.select(stamp(as_wall(F.col("start"))).alias("start"), "event_type", r6("mse").alias("mse"), "n")
