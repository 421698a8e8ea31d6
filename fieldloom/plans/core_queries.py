"""C, N and Q rows on the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import quantise as qz
from ..operators import statistics as st
from ..operators.layout import cells_to_field, field_to_cells
from ..session import shared_dir
from ..sizing import reused
from ..sources.fieldstore import write_colocated
from . import views as v
from .registry import q6, qstamp, query, r6, stamp
from .views import with_views

#: Of the co-located store.
STORE_BUCKETS = 16

PAIRS_SQL = """SELECT sample, c, i, j, y FROM latent"""


# --- channels ---------------------------------------------------------------

def _config(spark, sf):
    """A channel configuration read off the tables: event types on line-number levels."""
    pressure = v.table(spark, sf, "events").agg(F.array_sort(F.collect_set("event_type")).alias("pressure"))
    levels = v.table(spark, sf, "lineitem").agg(
        F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda x: x * 100.0).alias("levels"),
        F.array_sort(F.collect_set("l_returnflag")).alias("single"),
    )
    return pressure.select("pressure", levels.select("levels").scalar().alias("levels"),
                           levels.select("single").scalar().alias("single"))


CHANNEL_DIM = """p AS (SELECT event_type AS v, row_number() OVER (ORDER BY event_type) - 1 AS vi FROM (SELECT DISTINCT event_type FROM events)),
lv AS (SELECT l_linenumber AS l, row_number() OVER (ORDER BY l_linenumber) - 1 AS li FROM (SELECT DISTINCT l_linenumber FROM lineitem)),
s AS (SELECT l_returnflag AS v, row_number() OVER (ORDER BY l_returnflag) - 1 AS vi FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
dim AS (
  SELECT CAST(vi * (SELECT count(*) FROM lv) + li AS INTEGER) AS channel_idx, concat(v, '_', l * 100) AS name,
         v AS variable, CAST(l * 100 AS DOUBLE) AS level FROM p, lv
  UNION ALL
  SELECT CAST((SELECT count(*) FROM p) * (SELECT count(*) FROM lv) + vi AS INTEGER), v, v, CAST(NULL AS DOUBLE) FROM s)"""


@query("c01_channel_dim", f"WITH {CHANNEL_DIM} SELECT channel_idx, name, variable, level FROM dim")
def c01(spark, sf):
    return ch.channel_dim(_config(spark, sf))


WANTED = [500.0, 200.0, 900.0, 100.0]


def _levels(spark, sf):
    return v.climate(spark, sf).select("ts", "channel", ((F.col("i") + 1) * 100.0).alias("level"), "value")


@query(
    "c02_select_levels",
    f"""{with_views("climate")},
w AS (SELECT unnest([500.0, 200.0, 900.0, 100.0])::DOUBLE AS level, unnest([0, 1, 2, 3])::INTEGER AS level_idx)
SELECT w.level_idx, w.level, channel, count(*) AS n, {q6("avg(value)")} AS mean
FROM climate JOIN w ON w.level = (climate.i + 1) * 100 GROUP BY ALL""",
)
def c02(spark, sf):
    picked = ch.select_levels(_levels(spark, sf), WANTED)
    return picked.groupBy("level_idx", "level", "channel").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean")
    )


@query(
    "c02_missing_levels",
    f"""{with_views("climate")}
SELECT level FROM (SELECT unnest([500.0, 200.0, 900.0, 100.0])::DOUBLE AS level)
WHERE level NOT IN (SELECT (i + 1) * 100 FROM climate)""",
)
def c02_missing(spark, sf):
    return ch.missing_levels(_levels(spark, sf), WANTED)


STACK_SQL = f"""{with_views("latent")}
SELECT sample, i, j, string_agg(c, ',' ORDER BY c) AS channels,
       string_agg(CAST(CAST(round(y * CAST(1000000 AS DOUBLE)) AS BIGINT) AS VARCHAR), ',' ORDER BY c) AS micro
FROM latent GROUP BY sample, i, j"""


def _stacked(spark, sf):
    return ch.stack_fields(v.latent_fields(spark, sf), ["sample"], channel="c", band=8)


@query("c03_stack_channels", STACK_SQL)
def c03(spark, sf):
    micro = F.transform("values", lambda y: F.round(y * 1e6).cast("long").cast("string"))
    return _stacked(spark, sf).select(
        "sample", "i", "j",
        F.array_join(F.transform("channels", lambda c: c.cast("string")), ",").alias("channels"),
        F.array_join(micro, ",").alias("micro"),
    )


@query("c03_stack_cells", STACK_SQL)
def c03_cells(spark, sf):
    stacked = ch.stack_channels(v.latent(spark, sf), ["sample", "i", "j"], channel="c", value="y")
    micro = F.transform("values", lambda y: F.round(y * 1e6).cast("long").cast("string"))
    return stacked.select(
        "sample", "i", "j",
        F.array_join(F.transform("channels", lambda c: c.cast("string")), ",").alias("channels"),
        F.array_join(micro, ",").alias("micro"),
    )


@query(
    "c04_unstack_channels",
    f"""{with_views("latent")}, {CHANNEL_DIM}
SELECT sample, i, j, c AS channel_idx, name, {q6("y")} AS value FROM latent JOIN dim ON dim.channel_idx = latent.c""",
)
def c04(spark, sf):
    dim = ch.channel_dim(_config(spark, sf))
    out = ch.unstack_channels(_stacked(spark, sf), dim, ["sample", "i", "j"])
    return out.select("sample", "i", "j", "channel_idx", "name", r6("value").alias("value"))


@query(
    "c05_variable_names",
    """WITH codes AS (SELECT concat(upper(substr(l_returnflag, 1, 1)), '_GDS0_ISBL') AS code, count(*) AS n FROM lineitem GROUP BY ALL
  UNION ALL SELECT concat(CASE p_size % 4 WHEN 0 THEN 'Z' WHEN 1 THEN 'Q' WHEN 2 THEN 'CLWC' ELSE 'T' END, '_GDS0_ISBL'), count(*) FROM part GROUP BY ALL)
SELECT code, n, CASE code WHEN 'Z_GDS0_ISBL' THEN 'geopotential' WHEN 'Q_GDS0_ISBL' THEN 'specific humidity'
  WHEN 'CLWC_GDS0_ISBL' THEN 'specific_cloud_liquid_water_conten' WHEN 'T_GDS0_ISBL' THEN 'temperature'
  WHEN 'R_GDS0_ISBL' THEN 'relative_humidity' END AS long_name FROM codes""",
)
def c05(spark, sf):
    flags = v.table(spark, sf, "lineitem").groupBy(
        F.concat(F.upper(F.substring("l_returnflag", 1, 1)), F.lit("_GDS0_ISBL")).alias("code")
    ).agg(F.count(F.lit(1)).alias("n"))
    letters = F.array(*[F.lit(x) for x in ("Z", "Q", "CLWC", "T")])
    parts = v.table(spark, sf, "part").groupBy(
        F.concat(F.get(letters, F.col("p_size") % 4), F.lit("_GDS0_ISBL")).alias("code")
    ).agg(F.count(F.lit(1)).alias("n"))
    return ch.variable_names(flags.unionByName(parts))


UNITS_SQL = f"""{with_views("hourly")},
named AS (SELECT ts, CASE channel WHEN 'click' THEN 'tp' WHEN 'view' THEN 'tp6h' ELSE channel END AS variable, value FROM hourly)"""


def _named(spark, sf):
    c = F.col("channel")
    return v.hourly(spark, sf).select(
        "ts", F.when(c == "click", "tp").when(c == "view", "tp6h").otherwise(c).alias("variable"), "value"
    )


@query(
    "c06_convert_units",
    f"""{UNITS_SQL} SELECT {qstamp("ts")} AS ts, variable,
 {q6("CASE WHEN variable = 'tp' THEN value * 1000 ELSE value END")} AS exact,
 {q6("CASE WHEN contains(variable, 'tp') THEN value * 1000 ELSE value END")} AS contains FROM named""",
)
def c06(spark, sf):
    named = _named(spark, sf).withColumns({"exact": F.col("value"), "contains": F.col("value")})
    both = ch.convert_units(ch.convert_units(named, "exact", value="exact"), "contains", value="contains")
    return both.select(stamp("ts").alias("ts"), "variable", r6("exact").alias("exact"), r6("contains").alias("contains"))


@query(
    "c07_field_diff",
    f"""{with_views("latent", "recon")}
SELECT sample, c, i, j, {q6("orig")} AS orig, {q6("recon")} AS recon, {q6("abs(orig - recon)")} AS abs_diff
FROM recon WHERE c IN (0, 3)""",
)
def c07(spark, sf):
    out = ch.field_diff(v.latent_fields(spark, sf), v.recon_fields(spark, sf), ["sample", "c"], [0, 3], "c")
    return out.select(
        "sample", "c", "i", "j", r6("orig").alias("orig"), r6("recon").alias("recon"), r6("abs_diff").alias("abs_diff")
    )


@query(
    "c07_field_diff_colocated",
    f"""{with_views("latent", "recon")}
SELECT sample, c, i, j, {q6("orig")} AS orig, {q6("recon")} AS recon, {q6("abs(orig - recon)")} AS abs_diff FROM recon""",
)
def c07_colocated(spark, sf):
    base, keys = shared_dir(spark, "store"), ["sample", "c"]
    name = "fields_" + uuid.uuid4().hex
    sides = [
        write_colocated(fields, f"{name}_{side}", f"{base}/{side}", keys, STORE_BUCKETS)
        for side, fields in (("orig", v.latent_fields(spark, sf)), ("recon", v.recon_fields(spark, sf)))
    ]
    out = ch.field_diff(*sides, keys, range(4), "c")
    return out.select(
        "sample", "c", "i", "j", r6("orig").alias("orig"), r6("recon").alias("recon"), r6("abs_diff").alias("abs_diff")
    )


def _units(spark, sf):
    return v.table(spark, sf, "events").select(
        F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("unit")
    )


COMPLETE_SQL = f"""SELECT {qstamp("date_trunc('hour', ts)")} AS ts, count(DISTINCT event_type) AS arrived,
 count(DISTINCT event_type) >= 5 AS ready FROM events GROUP BY 1"""


@query("c08_sample_completeness", COMPLETE_SQL)
def c08(spark, sf):
    out = ch.sample_completeness(_units(spark, sf), 5, ["ts"], ["unit"])
    return out.select(stamp("ts").alias("ts"), "arrived", "ready")


@query(
    "c08_missing_units",
    f"""WITH u AS (SELECT DISTINCT date_trunc('hour', ts) AS ts, event_type AS unit FROM events),
k AS (SELECT DISTINCT event_type AS unit FROM events)
SELECT {qstamp("h.ts")} AS ts, k.unit FROM (SELECT DISTINCT ts FROM u) h, k
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.ts = h.ts AND u.unit = k.unit)""",
)
def c08_missing(spark, sf):
    units = _units(spark, sf)
    return ch.missing_units(units, units.select("unit").distinct(), ["ts"], "unit").select(stamp("ts").alias("ts"), "unit")


MOMENT_SQL = f"""{with_views("latent", "moments")}
SELECT sample, c, i, j, {q6("mean")} AS mean, {q6("logvar")} AS logvar, {q6("exp(logvar)")} AS var,
 {q6("exp(logvar / 2)")} AS std FROM moments"""


def _rounded_moments(df):
    return df.select("sample", "c", "i", "j", *[r6(x).alias(x) for x in ("mean", "logvar", "var", "std")])


@query("c09_split_moments", MOMENT_SQL)
def c09(spark, sf):
    return _rounded_moments(ch.split_moments_packed(v.moments_tensor(spark, sf), ["sample"], 4, 4, 4))


@query("c09_split_moments_cells", MOMENT_SQL)
def c09_cells(spark, sf):
    return _rounded_moments(ch.split_moments(v.latent(spark, sf), 2))


def _uniform(seed: int) -> str:
    digits = f"substr(md5(concat_ws(',', '{seed}', sample, c, i, j)), 1, 13)"
    return f"((CAST('0x' || {digits} AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE))"


@query(
    "c09_posterior_sample",
    f"""{with_views("latent", "moments")}
SELECT sample, c, i, j, {q6("mean")} AS certain,
 {q6(f"mean + exp(logvar / 2) * sqrt(-2 * ln({_uniform(5)})) * cos(2 * pi() * {_uniform(6)})")} AS drawn FROM moments""",
)
def c09_sample(spark, sf):
    moments = ch.split_moments_packed(v.moments_tensor(spark, sf), ["sample"], 4, 4, 4)
    out = ch.posterior_sample(moments, 5, ["sample", "c", "i", "j"], out="drawn")
    out = ch.posterior_sample(out, 5, ["sample", "c", "i", "j"], deterministic=True, out="certain")
    return out.select("sample", "c", "i", "j", r6("certain").alias("certain"), r6("drawn").alias("drawn"))


# --- statistics and normalisation -------------------------------------------

STATS = """stats AS (SELECT c, count(y) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM latent GROUP BY c)"""


def latent_stats(spark, sf):
    return reused(st.channel_stats(v.latent(spark, sf), ["c"], "y"))


@query(
    "n01_channel_stats",
    f"""{with_views("latent")}, {STATS}
SELECT c, n, {q6("mean")} AS mean, {q6("std")} AS std, CAST(0 AS BIGINT) AS n_null FROM stats""",
)
def n01(spark, sf):
    out = st.channel_stats(v.latent(spark, sf), ["c"], "y")
    return out.select("c", "n", r6("mean").alias("mean"), r6("std").alias("std"), "n_null")


def _with_variable(stats):
    return stats.withColumn("variable", F.when(F.col("c") < 2, "a").otherwise("b"))


@query(
    "n02_overall_stats",
    f"""{with_views("latent")},
o AS (SELECT CASE WHEN c < 2 THEN 'a' ELSE 'b' END AS variable, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM latent GROUP BY 1)
SELECT variable, c, n, {q6("mean")} AS mean, {q6("std")} AS std
FROM o JOIN (SELECT DISTINCT c FROM latent) k ON variable = CASE WHEN c < 2 THEN 'a' ELSE 'b' END""",
)
def n02(spark, sf):
    out = st.overall_stats(_with_variable(latent_stats(spark, sf)), "variable", "c")
    return out.select("variable", "c", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "n03_merge_stats",
    f"""SELECT event_type AS channel, count(*) AS n, {q6("avg(value)")} AS mean, {q6("stddev_pop(value)")} AS std, CAST(0 AS BIGINT) AS n_null
FROM events GROUP BY 1""",
)
def n03(spark, sf):
    daily = v.table(spark, sf, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("channel"), "value"
    )
    parts = st.channel_stats(daily, ["day", "channel"])
    return st.merge_stats(parts, ["channel"]).select(
        "channel", "n", r6("mean").alias("mean"), r6("std").alias("std"), "n_null"
    )


@query(
    "n04_standardize",
    f"""{with_views("latent")}, {STATS}
SELECT sample, c, i, j, {q6("(y - mean) / std")} AS y FROM latent JOIN stats USING (c)""",
)
def n04(spark, sf):
    out = st.standardize(v.latent(spark, sf), latent_stats(spark, sf), "channel", channel="c", value="y")
    return out.select("sample", "c", "i", "j", r6("y").alias("y"))


@query(
    "n04_standardize_overall",
    f"""{with_views("latent")},
o AS (SELECT CASE WHEN c < 2 THEN 'a' ELSE 'b' END AS variable, avg(y) AS mean, stddev_pop(y) AS std FROM latent GROUP BY 1)
SELECT sample, c, i, j, {q6("(y - mean) / std")} AS y FROM latent JOIN o ON variable = CASE WHEN c < 2 THEN 'a' ELSE 'b' END""",
)
def n04_overall(spark, sf):
    overall = st.overall_stats(_with_variable(latent_stats(spark, sf)), "variable", "c")
    cells = _with_variable(v.latent(spark, sf))
    out = st.standardize(cells, overall, "overall", channel="c", value="y")
    return out.select("sample", "c", "i", "j", r6("y").alias("y"))


@query(
    "n05_destandardize",
    f"""{with_views("latent")}, {STATS}
SELECT sample, c, i, j, {q6("y * std + mean")} AS y FROM latent JOIN stats USING (c)""",
)
def n05(spark, sf):
    out = st.destandardize(v.latent(spark, sf), latent_stats(spark, sf), channel="c", value="y")
    return out.select("sample", "c", "i", "j", r6("y").alias("y"))


CODES = """m AS (SELECT sample, c, min(y) AS shift, max(y) - min(y) AS scale FROM latent GROUP BY ALL),
codes AS (SELECT sample, c, i, j, shift, scale,
  CAST(CASE WHEN scale > 0 THEN floor((y - shift) / scale * 65535) ELSE 0 END AS INTEGER) AS code
  FROM latent JOIN m USING (sample, c))"""


@query(
    "n06_minmax_quantize",
    f"""{with_views("latent")}, {CODES}
SELECT sample, c, i, j, code, {q6("shift")} AS shift, {q6("scale")} AS scale FROM codes""",
)
def n06(spark, sf):
    stored = st.minmax_quantize(v.latent_fields(spark, sf))
    cells = field_to_cells(stored, ["sample", "c", "shift", "scale"], "code")
    return cells.select("sample", "c", "i", "j", "code", r6("shift").alias("shift"), r6("scale").alias("scale"))


@query(
    "n07_minmax_dequantize",
    f"""{with_views("latent")}, {CODES}
SELECT sample, c, i, j, {q6("code / CAST(65535 AS DOUBLE) * scale + shift")} AS y FROM codes""",
)
def n07(spark, sf):
    back = st.minmax_dequantize(st.minmax_quantize(v.latent_fields(spark, sf)))
    cells = field_to_cells(back, ["sample", "c"], "y")
    return cells.select("sample", "c", "i", "j", r6("y").alias("y"))


@query(
    "n08_cumulative_mse",
    f"""{with_views("latent", "recon")},
f AS (SELECT sample, avg((orig - recon) * (orig - recon)) AS mse FROM recon GROUP BY 1)
SELECT sample, round(avg(mse) OVER (ORDER BY sample), 9) AS running_mse FROM f""",
)
def n08(spark, sf):
    pairs = ch.pair_fields(v.latent_fields(spark, sf), v.recon_fields(spark, sf), ["sample", "c"])
    gap = F.col("orig") - F.col("recon")
    files = pairs.groupBy("sample").agg(F.avg(gap * gap).alias("mse"))
    out = st.cumulative_mse(files, "sample", block=256)
    return out.select("sample", F.round("running_mse", 9).alias("running_mse"))


@query(
    "n09_latent_channel_means",
    f"""{with_views("latent")},
s AS (SELECT sample, c, avg(y) AS m FROM latent GROUP BY ALL) SELECT c, {q6("avg(m)")} AS mean FROM s GROUP BY c""",
)
def n09(spark, sf):
    return st.latent_channel_means(v.latent_fields(spark, sf)).select("c", r6("mean").alias("mean"))


@query(
    "n10_channel_range",
    f"""{with_views("latent", "symbols")} SELECT c, min(sym) AS min, max(sym) AS max FROM symbols GROUP BY c""",
)
def n10(spark, sf):
    return st.channel_range(v.symbols(spark, sf))


def _ema_sql(decay: str) -> str:
    return f"""WITH RECURSIVE hourly AS (
  SELECT date_trunc('hour', ts) AS ts, event_type AS channel, avg(value) AS value FROM events GROUP BY ALL),
x AS (SELECT channel, datediff('hour', TIMESTAMP '1970-01-01', ts) AS hour, value,
             row_number() OVER (PARTITION BY channel ORDER BY ts) - 1 AS n FROM hourly),
e AS (SELECT channel, hour, n, value AS ema FROM x WHERE n = 0
  UNION ALL
  SELECT x.channel, x.hour, x.n, e.ema - (1 - {decay}) * (e.ema - x.value)
  FROM e JOIN x ON x.channel = e.channel AND x.n = e.n + 1)
SELECT channel, CAST(hour AS BIGINT) AS hour, {q6("ema")} AS ema FROM e"""


def _hour_series(spark, sf):
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return v.hourly(spark, sf).select(
        "channel", F.timestamp_diff("HOUR", epoch, F.col("ts")).cast("long").alias("hour"), "value"
    )


@query("n11_ema", _ema_sql("least(CAST(0.99 AS DOUBLE), CAST(1 + x.n AS DOUBLE) / CAST(10 + x.n AS DOUBLE))"))
def n11(spark, sf):
    out = st.ema(_hour_series(spark, sf), 0.99, True, ["channel"], "hour", block=256)
    return out.select("channel", "hour", r6("ema").alias("ema"))


@query("n11_ema_plain", _ema_sql("CAST(0.9 AS DOUBLE)"))
def n11_plain(spark, sf):
    out = st.ema(_hour_series(spark, sf), 0.9, False, ["channel"], "hour", block=256)
    return out.select("channel", "hour", r6("ema").alias("ema"))


# --- quantisation -----------------------------------------------------------

# Twenty times the latent, so that symbols spread, around the channel mean.
SCALED = "scaled AS (SELECT sample, c, i, j, y * CAST(20 AS DOUBLE) AS y, mean * CAST(20 AS DOUBLE) AS mean FROM latent JOIN stats USING (c))"
SCALED_SQL = f"{with_views('latent')}, {STATS}, {SCALED}"


def _scaled(spark, sf):
    stats = latent_stats(spark, sf).select("c", "mean")
    return v.latent(spark, sf).join(stats, "c").withColumns(
        {"y": F.col("y") * 20.0, "mean": F.col("mean") * 20.0}
    )


@query(
    "q01_quantize_dequantize",
    f"""{SCALED_SQL} SELECT sample, c, i, j, {q6("round_even(y - mean, 0) + mean")} AS y_hat FROM scaled""",
)
def q01(spark, sf):
    return _scaled(spark, sf).select(
        "sample", "c", "i", "j", r6(qz.quantize_dequantize(F.col("y"), F.col("mean"))).alias("y_hat")
    )


@query(
    "q02_quantize_symbols",
    f"""{SCALED_SQL} SELECT sample, c, i, j, CAST(round_even(y - mean, 0) AS INTEGER) AS sym FROM scaled""",
)
def q02(spark, sf):
    return _scaled(spark, sf).select(
        "sample", "c", "i", "j", qz.quantize_symbols(F.col("y"), F.col("mean")).alias("sym")
    )


@query(
    "q03_dequantize",
    f"""{SCALED_SQL} SELECT sample, c, i, j, {q6("CAST(round_even(y - mean, 0) AS INTEGER) + mean")} AS y_hat FROM scaled""",
)
def q03(spark, sf):
    sym = qz.quantize_symbols(F.col("y"), F.col("mean"))
    return _scaled(spark, sf).select(
        "sample", "c", "i", "j", r6(qz.dequantize(sym, F.col("mean"))).alias("y_hat")
    )


@query(
    "q04_quantize_noise",
    f"""{with_views("latent")} SELECT sample, c, i, j, {q6('y')} AS y,
 {q6("y + CAST('0x' || substr(md5(concat_ws(',', '7', sample, c, i, j)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) - 0.5")} AS y_noisy FROM latent""",
)
def q04(spark, sf):
    noisy = qz.quantize_noise(F.col("y"), 7, ["sample", "c", "i", "j"])
    return v.latent(spark, sf).select("sample", "c", "i", "j", r6("y").alias("y"), r6(noisy).alias("y_noisy"))


@query(
    "q05_scale_index",
    f"""{with_views("latent")},
t AS (SELECT k, exp(ln(CAST(0.11 AS DOUBLE)) + (ln(CAST(256 AS DOUBLE)) - ln(CAST(0.11 AS DOUBLE))) * k / CAST(63 AS DOUBLE)) AS bound
      FROM range(0, 63) r(k)),
s AS (SELECT sample, c, i, j, greatest(exp(y * CAST(20 AS DOUBLE)), CAST(0.11 AS DOUBLE)) AS s FROM latent)
SELECT sample, c, i, j, CAST((SELECT count(*) FROM t WHERE t.bound < s.s) AS INTEGER) AS idx FROM s""",
)
def q05(spark, sf):
    return v.latent(spark, sf).select(
        "sample", "c", "i", "j", qz.scale_index(F.exp(F.col("y") * 20.0)).alias("idx")
    )


@query(
    "q06_center_latent",
    f"""{SCALED_SQL}, r AS (SELECT sample, c, i, j, round_even((y - mean) * 5000, 0) AS r FROM scaled)
SELECT sample, c, i, j, CAST(CASE WHEN r BETWEEN -32768 AND 32767 THEN r END AS SMALLINT) AS centered,
 NOT (r BETWEEN -32768 AND 32767) AS overflow FROM r""",
)
def q06(spark, sf):
    wide = _scaled(spark, sf).select("sample", "c", "i", "j", (F.col("y") * 5000).alias("y"))
    means = latent_stats(spark, sf).select("c", (F.col("mean") * 20 * 5000).alias("mean"))
    return qz.center_latent(wide, means).select("sample", "c", "i", "j", "centered", "overflow")


# --- layout -----------------------------------------------------------------

@query(
    "layout_cells_to_field",
    f"""{with_views("latent")}
SELECT sample, c, string_agg(CASE WHEN (i + j + sample) % 5 = 0 THEN '-' ELSE CAST(CAST(round(y * CAST(1000000 AS DOUBLE)) AS BIGINT) AS VARCHAR) END, ',' ORDER BY i, j) AS micro
FROM latent GROUP BY ALL""",
)
def layout_cells(spark, sf):
    sparse = v.latent(spark, sf).where((F.col("i") + F.col("j") + F.col("sample")) % 5 != 0)
    packed = cells_to_field(sparse, ["sample", "c"], 4, 4, "y")
    micro = F.transform("values", lambda y: F.coalesce(F.round(y * 1e6).cast("long").cast("string"), F.lit("-")))
    return packed.select("sample", "c", F.array_join(micro, ",").alias("micro"))


@query(
    "layout_cells_to_dense_field",
    f"""{with_views("latent")}
SELECT sample, c, string_agg(CAST(CAST(round(y * CAST(1000000 AS DOUBLE)) AS BIGINT) AS VARCHAR), ',' ORDER BY i, j) AS micro
FROM latent GROUP BY ALL""",
)
def layout_dense(spark, sf):
    packed = cells_to_field(v.latent(spark, sf), ["sample", "c"], 4, 4, "y")
    micro = F.transform("values", lambda y: F.round(y * 1e6).cast("long").cast("string"))
    return packed.select("sample", "c", F.array_join(micro, ",").alias("micro"))


# --- statistics documents -----------------------------------------------------

def _stats_doc(spark, sf):
    """One document from the climate view: a list per channel over its rows, an overall number each."""
    climate = v.climate(spark, sf)
    per_row = climate.groupBy("channel", "i").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    lists = per_row.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("p"))
    overall = climate.groupBy("channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    texts = lists.select("channel", F.to_json("p.m").alias("m"), F.to_json("p.s").alias("s")).unionByName(
        overall.select(F.concat("channel", F.lit("_overall")).alias("channel"),
                       F.col("m").cast("string").alias("m"), F.col("s").cast("string").alias("s"))
    )
    entry = lambda c: F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), "channel", F.lit('":'), c)))
    return texts.agg(
        F.concat(F.lit('{"mean":{'), entry("m"), F.lit('},"std":{'), entry("s"), F.lit('},"count":7}')).alias("text")
    )


STATS_DIM = """lv AS (SELECT channel, i, avg(value) AS mean, stddev_pop(value) AS std FROM climate GROUP BY ALL),
ov AS (SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM climate GROUP BY 1),
dim AS (SELECT channel AS variable, i, CAST(100 * (i + 1) AS DOUBLE) AS level,
  CAST(row_number() OVER (ORDER BY channel, i) - 1 AS INTEGER) AS channel_idx FROM lv)"""


def _documented(spark, sf, norm_type):
    from ..sources.fieldstore import channel_statistics, parse_stats_docs

    climate = v.climate(spark, sf)
    config = climate.agg(F.array_sort(F.collect_set("channel")).alias("pressure")).select(
        "pressure", F.array(*[F.lit(100.0 * (k + 1)) for k in range(v.CLIMATE_ROWS)]).alias("levels"),
        F.array().cast("array<string>").alias("single"),
    )
    levels = [100.0 * (k + 1) for k in range(v.CLIMATE_ROWS)]
    out = channel_statistics(parse_stats_docs(_stats_doc(spark, sf)), ch.channel_dim(config), levels, norm_type)
    return out.select("channel_idx", "variable", "level", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "n04_channel_statistics",
    f"""{with_views("climate")}, {STATS_DIM}
SELECT channel_idx, variable, level, {q6("mean")} AS mean, {q6("std")} AS std FROM dim JOIN lv ON channel = variable AND lv.i = dim.i""",
)
def n04_documented(spark, sf):
    return _documented(spark, sf, "channel")


@query(
    "n04_channel_statistics_overall",
    f"""{with_views("climate")}, {STATS_DIM}
SELECT channel_idx, variable, level, {q6("mean")} AS mean, {q6("std")} AS std FROM dim JOIN ov ON channel = variable""",
)
def n04_documented_overall(spark, sf):
    return _documented(spark, sf, "overall")
