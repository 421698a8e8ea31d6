"""E rows on the shared tables: symbol statistics, rate and context modelling."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import entropy as en
from ..operators import likelihood as lk
from ..operators import scoring as sc
from ..session import checkpointed
from ..sizing import reused
from . import views as v
from .registry import q6, query, r6
from .views import with_views

SYMBOLS = with_views("latent", "symbols")
HIST = "hist AS (SELECT c, sym, count(*) AS n FROM symbols GROUP BY ALL)"
SUPPORT = "support AS (SELECT c, min(sym) - 1 AS lo, max(sym) + 1 AS hi FROM symbols GROUP BY c)"


def cdf_sql(name: str, keys: str, hist: str, groups: str) -> str:
    """A 16-bit CDF per group of ``hist``; the pull-down from the top is written as a
    running minimum from the last edge."""
    on = " AND ".join(f"h.{k} = d.{k}" for k in keys.split(", "))
    return f"""{name}_t AS (SELECT g.*, t.total FROM {groups} g LEFT JOIN
    (SELECT {keys}, CAST(sum(n) AS DOUBLE) AS total FROM {hist} GROUP BY ALL) t USING ({keys})),
{name}_d AS (SELECT g.*, lo, hi, unnest(range(0, hi - lo + 1)) AS k FROM {name}_t g JOIN support USING (c)),
{name}_w AS (SELECT d.*, CASE WHEN d.k = 0 THEN 0 ELSE greatest(1, CAST(round(coalesce(h.n, 0) * coalesce(65535 / d.total, 0)) AS BIGINT)) END AS w
    FROM {name}_d d LEFT JOIN {hist} h ON {on} AND h.sym = d.lo + d.k - 1),
{name}_r AS (SELECT *, CASE WHEN k = hi - lo THEN 65536 ELSE sum(w) OVER (PARTITION BY {keys} ORDER BY k) END AS raw FROM {name}_w),
{name}_c AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE min(raw - k) OVER (PARTITION BY {keys} ORDER BY k DESC) + k END AS cproba FROM {name}_r),
{name} AS (SELECT {keys}, CAST(k AS INTEGER) AS k, CAST(lo + k AS INTEGER) AS sym, CAST(cproba AS BIGINT) AS cproba,
    CAST(lead(cproba) OVER (PARTITION BY {keys} ORDER BY k) - cproba AS BIGINT) AS step FROM {name}_c)"""


def bits_sql(name: str, hist: str, cdf: str, keys: str, out: str) -> str:
    return f"""{name} AS (SELECT {out}, CAST(sum(n * (16 - log2(CAST(step AS DOUBLE)))) AS DOUBLE) / sum(n) AS bits, CAST(sum(n) AS BIGINT) AS n
    FROM {hist} JOIN {cdf} USING ({keys}, sym) WHERE step IS NOT NULL GROUP BY ALL)"""


PLAIN = f"{SYMBOLS}, {HIST}, {SUPPORT}, {cdf_sql('cdf', 'c', 'hist', '(SELECT c FROM support)')}"
MODE = f"""{PLAIN}, mode AS (SELECT c, sym AS mode, step FROM cdf WHERE step IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY step DESC, k) = 1)"""
DEVS = """devs AS (SELECT s.sample, s.c, s.i, s.j, s.sym, abs(s.sym - mode) AS own_dev,
    coalesce(abs(u.sym - mode), -1) AS up_dev, coalesce(abs(l.sym - mode), -1) AS left_dev
  FROM symbols s JOIN mode USING (c)
  LEFT JOIN symbols u ON u.sample = s.sample AND u.c = s.c AND u.i = s.i - 1 AND u.j = s.j
  LEFT JOIN symbols l ON l.sample = s.sample AND l.c = s.c AND l.i = s.i AND l.j = s.j - 1)"""
SEARCH = f"""{MODE}, {DEVS},
limits AS (SELECT c, greatest(1, least(abs(lo - mode), abs(hi - mode))) AS th_max FROM support JOIN mode USING (c)),
ths AS (SELECT c, unnest(range(0, th_max)) AS th FROM limits),
th_hist AS (SELECT c, th, CAST(up_dev > th AS INTEGER) + CAST(left_dev > th AS INTEGER) AS ctx, sym, count(*) AS n
  FROM devs JOIN ths USING (c) GROUP BY ALL),
{cdf_sql('th_cdf', 'c, th, ctx', 'th_hist', '(SELECT c, th, unnest([0, 1, 2]) AS ctx FROM ths)')},
{bits_sql('th_bits', 'th_hist', 'th_cdf', 'c, th, ctx', 'c, th')},
best AS (SELECT c, CAST(th AS INTEGER) AS th, bits FROM th_bits
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(bits, 9), th) = 1)"""
CONTEXT = f"""{SEARCH}, ctx AS (SELECT sample, c, i, j, sym, own_dev, th,
  CAST(up_dev > th AS INTEGER) + CAST(left_dev > th AS INTEGER) AS ctx FROM devs JOIN best USING (c))"""
CTX_CDF = f"""{CONTEXT}, ctx_hist AS (SELECT c, ctx, sym, count(*) AS n FROM ctx GROUP BY ALL),
{cdf_sql('ctx_cdf', 'c, ctx', 'ctx_hist', '(SELECT c, unnest([0, 1, 2]) AS ctx FROM support)')}"""


class Model(NamedTuple):
    """Per-channel tables that the context queries share."""

    fields: DataFrame
    hist: DataFrame
    support: DataFrame
    cdf: DataFrame
    modes: DataFrame


def _histogram(spark, sf) -> DataFrame:
    return reused(en.symbol_histogram(v.symbols(spark, sf)))


def _model(spark, sf) -> Model:
    """Two passes' worth of state: the histogram and its CDF are reused, the rest is cheap to derive."""
    fields = v.symbol_fields(spark, sf)
    hist = _histogram(spark, sf)
    support = checkpointed(en.symbol_support(hist))
    cdf = reused(en.symbol_cdf(hist, support=support))
    return Model(fields, hist, support, cdf, checkpointed(en.most_probable_symbol(cdf)))


def _thresholds(m: Model) -> DataFrame:
    found = en.best_threshold(en.threshold_entropy(m.fields, m.modes, m.support))
    return checkpointed(found)  # a row per channel, at the end of a long plan


@query("e01_symbol_histogram", f"{SYMBOLS}, {HIST} SELECT c, sym, n FROM hist")
def e01(spark, sf):
    return en.symbol_histogram(v.symbols(spark, sf))


@query("e02_symbol_cdf", f"{PLAIN} SELECT c, k, sym, cproba, step FROM cdf")
def e02(spark, sf):
    return en.symbol_cdf(_histogram(spark, sf))


@query("e03_most_probable_symbol", f"{MODE} SELECT c, mode, step FROM mode")
def e03(spark, sf):
    return en.most_probable_symbol(en.symbol_cdf(_histogram(spark, sf)))


@query("e04_cross_entropy", f"{PLAIN}, {bits_sql('b', 'hist', 'cdf', 'c', 'c')} SELECT c, {q6('bits')} AS bits, n, CAST(0 AS BIGINT) AS n_unpriced FROM b")
def e04(spark, sf):
    hist = _histogram(spark, sf)
    return en.cross_entropy(hist, en.symbol_cdf(hist)).select("c", r6("bits").alias("bits"), "n", "n_unpriced")


@query("e05_spatial_context", f"{CONTEXT} SELECT sample, c, i, j, sym, ctx FROM ctx")
def e05(spark, sf):
    m = _model(spark, sf)
    return en.spatial_context(m.fields, m.modes, _thresholds(m)).select("sample", "c", "i", "j", "sym", "ctx")


@query("e06_context_cdf", f"{CTX_CDF} SELECT c, ctx, k, sym, cproba, step FROM ctx_cdf")
def e06(spark, sf):
    m = _model(spark, sf)
    hist = reused(en.context_histogram(en.spatial_context(m.fields, m.modes, _thresholds(m))))
    return en.context_cdf(hist, support=m.support)


@query(
    "e07_context_entropy",
    f"{CTX_CDF}, {bits_sql('b', 'ctx_hist', 'ctx_cdf', 'c, ctx', 'c')} SELECT c, {q6('bits')} AS bits, n FROM b",
)
def e07(spark, sf):
    m = _model(spark, sf)
    hist = reused(en.context_histogram(en.spatial_context(m.fields, m.modes, _thresholds(m))))
    cdf = en.context_cdf(hist, support=m.support)
    return en.context_entropy(hist, cdf).select("c", r6("bits").alias("bits"), "n")


@query("e08_best_threshold", f"{SEARCH} SELECT c, th, {q6('bits')} AS bits FROM best")
def e08(spark, sf):
    return _thresholds(_model(spark, sf)).select("c", "th", r6("bits").alias("bits"))


@query(
    "e08_threshold_entropy",
    f"{SEARCH} SELECT c, CAST(th AS INTEGER) AS th, {q6('bits')} AS bits, n FROM th_bits",
)
def e08_all(spark, sf):
    m = _model(spark, sf)
    return en.threshold_entropy(m.fields, m.modes, m.support).select("c", "th", r6("bits").alias("bits"), "n")


# Coding order 2, 0, 3, 1 for the rows that take the order as given.
ORDER = "ord AS (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([2, 0, 3, 1]) AS c)"
CHANNEL_CTX = f"""{CONTEXT}, {ORDER},
prev AS (SELECT a.c, b.c AS p FROM ord a LEFT JOIN ord b ON b.pos = a.pos - 1),
ctx4 AS (SELECT x.sample, x.c, x.i, x.j, x.sym, x.ctx + CAST(coalesce(y.own_dev > y.th, false) AS INTEGER) AS ctx
  FROM ctx x JOIN prev USING (c) LEFT JOIN ctx y ON y.sample = x.sample AND y.c = prev.p AND y.i = x.i AND y.j = x.j)"""


def _given_order(spark):
    return spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "pos int, c int")


@query("e09_channel_context", f"{CHANNEL_CTX} SELECT sample, c, i, j, sym, ctx FROM ctx4")
def e09(spark, sf):
    m = _model(spark, sf)
    return en.channel_context(m.fields, m.modes, _thresholds(m), _given_order(spark))


@query(
    "e10_channel_context_entropy",
    f"""{CHANNEL_CTX}, h4 AS (SELECT c, ctx, sym, count(*) AS n FROM ctx4 GROUP BY ALL),
{cdf_sql('cdf4', 'c, ctx', 'h4', '(SELECT c, unnest([0, 1, 2, 3]) AS ctx FROM support)')},
{bits_sql('b', 'h4', 'cdf4', 'c, ctx', 'c')} SELECT c, {q6('bits')} AS bits, n FROM b""",
)
def e10(spark, sf):
    m = _model(spark, sf)
    out = en.channel_context_entropy(m.fields, m.modes, _thresholds(m), _given_order(spark), m.support)
    return out.select("c", r6("bits").alias("bits"), "n")


GAINS = f"""{CONTEXT},
wide AS (SELECT c FROM support WHERE hi - lo > 4),
ph AS (SELECT y.c AS prev, x.c, x.ctx + CAST(y.own_dev > y.th AS INTEGER) AS ctx, x.sym, count(*) AS n
  FROM ctx x JOIN ctx y ON y.sample = x.sample AND y.i = x.i AND y.j = x.j AND y.c <> x.c
  WHERE x.c IN (SELECT c FROM wide) AND y.c IN (SELECT c FROM wide) GROUP BY ALL),
{cdf_sql('pc', 'prev, c, ctx', 'ph', '(SELECT DISTINCT prev, c, ctx FROM ph)')},
{bits_sql('pb', 'ph', 'pc', 'prev, c, ctx', 'prev, c')},
{bits_sql('b', 'hist', 'cdf', 'c', 'c')},
gains AS (SELECT prev, c, b.bits - pb.bits AS gain FROM pb JOIN b USING (c))"""


def _gains(m: Model) -> DataFrame:
    bits = en.cross_entropy(m.hist, m.cdf)
    return en.channel_gains(m.fields, m.modes, _thresholds(m), m.support, bits)


@query("e11_channel_gains", f"{GAINS} SELECT prev, c, {q6('gain')} AS gain FROM gains")
def e11_gains(spark, sf):
    return _gains(_model(spark, sf)).select("prev", "c", r6("gain").alias("gain"))


@query(
    "e11_channel_order",
    f"""{GAINS.replace("WITH ", "WITH RECURSIVE ", 1)},
walk AS (SELECT 0 AS pos, c, [c] AS done FROM (SELECT c FROM support ORDER BY hi - lo DESC, c LIMIT 1)
  UNION ALL
  SELECT pos + 1, nxt, list_append(done, nxt) FROM
    (SELECT w.pos, w.done, (SELECT g.c FROM gains g WHERE g.prev = w.c AND NOT list_contains(w.done, g.c) AND g.gain > -1
       ORDER BY round(g.gain, 9) DESC, g.c LIMIT 1) AS nxt FROM walk w) WHERE nxt IS NOT NULL),
rest AS (SELECT c, row_number() OVER (ORDER BY CASE WHEN hi - lo > 4 THEN 0 ELSE 1 END, c) AS r FROM support WHERE c NOT IN (SELECT c FROM walk))
SELECT CAST(pos AS INTEGER) AS pos, c FROM walk
UNION ALL SELECT CAST((SELECT max(pos) FROM walk) + r AS INTEGER), c FROM rest""",
)
def e11(spark, sf):
    m = _model(spark, sf)
    return en.channel_order(m.support, _gains(m))


@query(
    "e12_channel_activation",
    f"""{MODE}, act AS (SELECT c, sample, max(CASE WHEN sym <> mode THEN 1 ELSE 0 END) AS a FROM symbols JOIN mode USING (c) GROUP BY ALL)
SELECT c, CAST(greatest(1, least(65535, round(sum(a) * (CAST(65536 AS DOUBLE) / count(*))))) AS INTEGER) AS proba FROM act GROUP BY c""",
)
def e12(spark, sf):
    m = _model(spark, sf)
    return en.channel_activation(m.fields, m.modes)


@query(
    "e13_pmf_to_cdf",
    f"""{f"{SYMBOLS}, {HIST}".replace("WITH ", "WITH RECURSIVE ", 1)},
p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY sym) - 1 AS k,
  CAST(floor(n / CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE) * 65536 + 0.5) AS BIGINT) AS freq FROM hist),
s AS (SELECT c, k, freq * 65536 // CAST(sum(freq) OVER (PARTITION BY c) AS BIGINT) AS w FROM p),
l AS (SELECT c, list(w ORDER BY k) AS w, sum(w) AS total FROM s GROUP BY c),
steal AS (SELECT c, 0 AS step, list_concat(w[:-2], [w[-1] + 65536 - CAST(total AS BIGINT)]) AS w FROM l
  UNION ALL
  SELECT c, step + 1, [CASE WHEN i = list_position(w, 0) THEN 1
      WHEN i = list_position(w, list_min([x FOR x IN w IF x > 1])) THEN w[i] - 1 ELSE w[i] END FOR i IN range(1, len(w) + 1)]
  FROM steal WHERE list_contains(w, 0)),
done AS (SELECT c, w FROM steal WHERE NOT list_contains(w, 0))
SELECT c, CAST(k AS INTEGER) AS k, CAST(coalesce(list_sum(w[:k]), 0) AS BIGINT) AS cproba
FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS k FROM done)""",
)
def e13(spark, sf):
    m = _model(spark, sf)
    total = m.hist.groupBy("c").agg(F.sum("n").alias("_t"))
    pmf = m.hist.join(total, "c").select(
        "c", (F.row_number().over(en.W.partitionBy("c").orderBy("sym")) - 1).alias("k"),
        (F.col("n") / F.col("_t")).alias("p"),
    )
    return en.pmf_to_cdf(pmf)


# --- likelihoods --------------------------------------------------------------

def erfc_sql(x: str) -> str:
    """DuckDB has no erfc either.  An independent route: Simpson's rule on the tail
    integral scaled by its Gaussian, fine enough for eight digits."""
    steps, span = 1200, 6.0
    h = span / steps
    # erfc(a) = 2/sqrt(pi) * exp(-a^2) * integral_0^inf exp(-t^2 - 2 a t) dt
    weight = "CASE WHEN t IN (0, {n}) THEN 1 WHEN t % 2 = 1 THEN 4 ELSE 2 END".format(n=steps)
    body = f"exp(-(t * {h}) * (t * {h}) - 2 * abs({x}) * (t * {h}))"
    integral = f"list_sum(list_transform(range(0, {steps + 1}), lambda t: ({weight}) * {body})) * {h / 3}"
    tail = f"(2 / sqrt(pi()) * exp(-({x}) * ({x})) * ({integral}))"
    return f"(CASE WHEN ({x}) < 0 THEN 2 - {tail} ELSE {tail} END)"


# y in twentieths around the channel mean, with a scale per row of the grid.
LIK_IN = f"""{with_views("latent")}, stats AS (SELECT c, avg(y) AS mean FROM latent GROUP BY c),
g AS (SELECT sample, c, i, j, y * CAST(20 AS DOUBLE) AS y, mean * CAST(20 AS DOUBLE) AS mean, CAST(0.05 + 1.5 * i AS DOUBLE) AS scale FROM latent JOIN stats USING (c)),
a AS (SELECT *, (abs(y - mean) - 0.5) / (greatest(scale, CAST(0.11 AS DOUBLE)) * sqrt(2)) AS x1,
             (abs(y - mean) + 0.5) / (greatest(scale, CAST(0.11 AS DOUBLE)) * sqrt(2)) AS x2 FROM g),
lik AS (SELECT sample, c, i, j, greatest(0.5 * {erfc_sql("x1")} - 0.5 * {erfc_sql("x2")}, CAST(1e-9 AS DOUBLE)) AS likelihood FROM a)"""


def _likelihoods(spark, sf):
    from .core_queries import _scaled

    cells = _scaled(spark, sf).withColumn("scale", 0.05 + 1.5 * F.col("i"))
    return lk.gaussian_likelihood(cells, mean="mean").select("sample", "c", "i", "j", "likelihood")


@query("e14_gaussian_likelihood", f"{LIK_IN} SELECT sample, c, i, j, {q6('likelihood')} AS likelihood FROM lik")
def e14(spark, sf):
    return _likelihoods(spark, sf).select("sample", "c", "i", "j", r6("likelihood").alias("likelihood"))


BITS = "bits AS (SELECT sample, -sum(log2(likelihood)) AS bits, -sum(log2(likelihood)) / 16 AS bpp FROM lik GROUP BY 1)"


@query(
    "e15_bits_from_likelihood",
    f"{LIK_IN}, {BITS} SELECT sample, round(bits, 3) AS bits, round(bpp, 4) AS bpp, CAST(0 AS BIGINT) AS n_null FROM bits",
)
def e15(spark, sf):
    out = lk.bits_from_likelihood(_likelihoods(spark, sf), 16)
    return out.select("sample", F.round("bits", 3).alias("bits"), F.round("bpp", 4).alias("bpp"), "n_null")


@query(
    "e16_rate_distortion",
    f"""{LIK_IN}, {BITS}, {v.CTE["recon"]},
err AS (SELECT sample, avg((orig - recon) * (orig - recon)) AS mse FROM recon GROUP BY 1)
SELECT sample, {q6("0.01 * bpp")} AS bpp_loss, {q6("100 * mse")} AS mse_loss FROM bits JOIN err USING (sample)""",
)
def e16(spark, sf):
    bits = lk.bits_from_likelihood(_likelihoods(spark, sf), 16)
    pairs = ch.pair_fields(v.latent_fields(spark, sf), v.recon_fields(spark, sf), ["sample", "c"])
    out = lk.rate_distortion(bits, sc.mse(pairs, ["sample"]), lmbda=100.0)
    return out.select("sample", r6("bpp_loss").alias("bpp_loss"), r6("mse_loss").alias("mse_loss"))


@query(
    "e16_logvar_distortion",
    f"""{with_views("latent", "recon")}
SELECT sample, {q6("avg((orig - recon) * (orig - recon) / exp(CAST(c AS DOUBLE) / 4 - 1) + (CAST(c AS DOUBLE) / 4 - 1))")} AS mse_loss FROM recon GROUP BY 1""",
)
def e16_logvar(spark, sf):
    pairs = ch.pair_fields(v.latent_fields(spark, sf), v.recon_fields(spark, sf), ["sample", "c"])
    logvars = v.latent_fields(spark, sf).select("c").distinct().withColumn("logvar", F.col("c") / 4.0 - 1.0)
    return lk.logvar_distortion(pairs, logvars).select("sample", r6("mse_loss").alias("mse_loss"))


def _moments(spark, sf):
    return ch.split_moments_packed(v.moments_tensor(spark, sf), ["sample"], 4, 4, 4)


@query(
    "e17_gaussian_kl",
    f"""{with_views("latent", "moments")}
SELECT sample, {q6("0.5 * avg(mean * mean + exp(logvar) - 1 - logvar)")} AS kl,
 {q6("0.5 * avg((mean - 0.1) * (mean - 0.1) / exp(CAST(0.5 AS DOUBLE)) + exp(logvar) / exp(CAST(0.5 AS DOUBLE)) - 1 - logvar + 0.5)")} AS kl_other
FROM moments GROUP BY sample""",
)
def e17(spark, sf):
    moments = _moments(spark, sf).withColumns({"mean2": F.lit(0.1), "logvar2": F.lit(0.5)})
    unit = lk.gaussian_kl(moments)
    other = lk.gaussian_kl(moments, other=True).withColumnRenamed("kl", "kl_other")
    return unit.join(other, "sample").select("sample", r6("kl").alias("kl"), r6("kl_other").alias("kl_other"))


@query(
    "e18_gaussian_nll",
    f"""{with_views("latent", "moments")}
SELECT sample, {q6("0.5 * sum(ln(2 * pi()) + logvar + (0.05 * i - mean) * (0.05 * i - mean) / exp(logvar))")} AS nll FROM moments GROUP BY sample""",
)
def e18(spark, sf):
    moments = _moments(spark, sf).withColumn("x", 0.05 * F.col("i"))
    return lk.gaussian_nll(moments, "x").select("sample", r6("nll").alias("nll"))


@query(
    "e19_bits_per_pixel",
    """SELECT doc_id, CAST(octet_length(encode(text)) * 8 AS BIGINT) AS total_bits, octet_length(encode(text)) * 8 / CAST(256 AS DOUBLE) AS bpp,
 octet_length(encode(text)) * 8 / CAST(1024 AS DOUBLE) AS bpsp FROM documents""",
)
def e19(spark, sf):
    from ..sources.containers import container_catalog, container_pack

    docs = v.table(spark, sf, "documents").select(
        "doc_id", F.lit(4).alias("z_h"), F.lit(4).alias("z_w"), F.array(F.encode("text", "UTF-8")).alias("strings")
    )
    catalog = container_catalog(container_pack(docs))
    return lk.bits_per_pixel(catalog, 4, 16, 16).select("doc_id", "total_bits", "bpp", "bpsp")


@query(
    "e20_bitrate_kbps",
    f"""SELECT doc_id, {q6("n_chars * 8 * CAST(30000 AS DOUBLE) / 1001 / ((doc_id % 50 + 1) * 1000)")} AS kbps FROM documents""",
)
def e20(spark, sf):
    seq = v.table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").alias("bytes"), (F.col("doc_id") % 50 + 1).alias("frames"),
        F.lit(30000 / 1001).alias("fps"),
    )
    return lk.bitrate_kbps(seq).select("doc_id", r6("kbps").alias("kbps"))
