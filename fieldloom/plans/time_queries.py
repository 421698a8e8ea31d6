"""T rows, forecast scores (M03-M05) and latitude weights (G11) on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..operators import spatial as sp
from ..operators import timeaxis as tx
from ..operators.layout import cells_to_field
from . import views as v
from .registry import q6, qstamp, query, r6, stamp
from .views import with_views

INPUTS, TARGETS = [0, 6], [6, 24]


def _hours(spark, sf):
    return v.table(spark, sf, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    ).distinct()


HOURS = "hours AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events)"


@query(
    "t01_timestamp_grid",
    f"""SELECT event_type, {qstamp("unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 23 HOUR, INTERVAL 6 HOUR))")} AS ts
FROM events GROUP BY event_type""",
)
def t01(spark, sf):
    bounds = v.table(spark, sf, "events").groupBy("event_type").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    return tx.timestamp_grid(bounds, 6).select("event_type", stamp("ts").alias("ts"))


PAIRS = """pairs AS (
  SELECT ts, 'input' AS role, 0 AS k, ts AS valid_ts FROM hours
  UNION ALL SELECT ts, 'input', 1, ts + INTERVAL 6 HOUR FROM hours
  UNION ALL SELECT ts, 'target', 0, ts + INTERVAL 12 HOUR FROM hours
  UNION ALL SELECT ts, 'target', 1, ts + INTERVAL 30 HOUR FROM hours)"""


@query(
    "t02_lead_pairs",
    f"""{with_views("hourly")}, {HOURS}, {PAIRS}
SELECT {qstamp("p.ts")} AS ts, role, k, {qstamp("valid_ts")} AS valid_ts, channel, {q6("value")} AS value
FROM pairs p JOIN hourly h ON h.ts = p.valid_ts""",
)
def t02(spark, sf):
    pairs = tx.lead_pairs(_hours(spark, sf), INPUTS, TARGETS)
    out = tx.join_leads(pairs, v.hourly(spark, sf))
    return out.select(
        stamp("ts").alias("ts"), "role", "k", stamp("valid_ts").alias("valid_ts"), "channel", r6("value").alias("value")
    )


@query(
    "t03_valid_anchors",
    f"""WITH {HOURS} SELECT {qstamp("ts")} AS ts FROM hours
QUALIFY row_number() OVER (ORDER BY ts) <= (SELECT count(*) FROM hours) - 5""",
)
def t03(spark, sf):
    return tx.valid_anchors(_hours(spark, sf), INPUTS, TARGETS, 6).select(stamp("ts").alias("ts"))


@query(
    "t04_limit_anchors_keep",
    f"""WITH {HOURS} SELECT {qstamp("ts")} AS ts FROM hours ORDER BY hours.ts LIMIT 100""",
)
def t04_keep(spark, sf):
    return tx.limit_anchors(_hours(spark, sf), 100, "keep").select(stamp("ts").alias("ts"))


@query(
    "t04_limit_anchors_skip",
    f"""WITH {HOURS} SELECT {qstamp("ts")} AS ts FROM hours QUALIFY row_number() OVER (ORDER BY hours.ts) > 100""",
)
def t04_skip(spark, sf):
    return tx.limit_anchors(_hours(spark, sf), 100, "skip").select(stamp("ts").alias("ts"))


@query(
    "t05_date_split",
    f"""{with_views("climate")}
SELECT channel, i, count(*) AS n, {q6("avg(value)")} AS mean, {qstamp("min(ts)")} AS first, {qstamp("max(ts)")} AS last
FROM climate WHERE ts >= TIMESTAMP '1998-05-04' AND ts < TIMESTAMP '2018-01-01' GROUP BY ALL""",
)
def t05(spark, sf):
    train = tx.date_split(v.climate(spark, sf), "train")
    return train.groupBy("channel", "i").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"),
        stamp(F.min("ts")).alias("first"), stamp(F.max("ts")).alias("last"),
    )


CLIM = """clim AS (SELECT strftime(ts, '%m-%d') AS md, channel, i, avg(value) AS clim FROM climate
  WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2001-01-01' GROUP BY ALL)"""


def _clim(spark, sf):
    return tx.daily_climatology_fields(v.climate_fields(spark, sf), 1996, 2000, ["channel"])


def _rows(fields, *keys):
    """One row per cell of packed columns ``values``, ``pred``, ``truth`` or ``clim``."""
    arrays = [c for c in ("values", "pred", "truth", "clim") if c in fields.columns]
    zipped = F.posexplode(F.arrays_zip(*[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in arrays])).alias("i", "_z")
    return fields.select(*keys, zipped).select(*keys, "i", *[F.col(f"_z.{c}").alias("value" if c == "values" else c) for c in arrays])


@query(
    "t06_climatology_lookup",
    f"""{with_views("climate")}, {CLIM}
SELECT strftime(t.ts, '%m-%d') AS md, {qstamp("t.ts")} AS ts, t.channel, t.i, {q6("t.value")} AS value, {q6("clim")} AS clim
FROM climate t LEFT JOIN clim k ON k.md = strftime(t.ts, '%m-%d') AND k.channel = t.channel AND k.i = t.i""",
)
def t06(spark, sf):
    fields = tx.climatology_fields(v.climate_fields(spark, sf), _clim(spark, sf), ["channel"])
    out = _rows(fields, "md", "ts", "channel").where("value IS NOT NULL")
    return out.select(
        "md", stamp("ts").alias("ts"), "channel", "i", r6("value").alias("value"), r6("clim").alias("clim")
    )


@query("t07_daily_climatology", f"""{with_views("climate")}, {CLIM} SELECT md, channel, i, {q6("clim")} AS clim FROM clim""")
def t07(spark, sf):
    return _rows(_clim(spark, sf), "md", "channel").where("clim IS NOT NULL").select("md", "channel", "i", r6("clim").alias("clim"))


@query(
    "t08_accumulate_hours",
    f"""{with_views("hourly")},
a AS (SELECT ts, channel, value, count(value) OVER w AS n, sum(value) OVER w AS s FROM hourly
  WINDOW w AS (PARTITION BY channel ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW))
SELECT {qstamp("ts")} AS ts, channel, {q6("value")} AS value, {q6("CASE WHEN n = 6 THEN s END")} AS accumulated FROM a""",
)
def t08(spark, sf):
    out = tx.accumulate_hours(v.hourly(spark, sf), 6, ["channel"], chunk_hours=48)
    return out.select(
        stamp("ts").alias("ts"), "channel", r6("value").alias("value"), r6("accumulated").alias("accumulated")
    )


@query(
    "t08_accumulate_fields",
    f"""{with_views("hourly")},
a AS (SELECT ts, channel, value, count(value) OVER w AS n, sum(value) OVER w AS s FROM hourly
  WINDOW w AS (PARTITION BY channel ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW))
SELECT {qstamp("ts")} AS ts, channel, {q6("value")} AS value, {q6("CASE WHEN n = 6 THEN s END")} AS accumulated,
 {q6("CASE WHEN n = 6 THEN 2 * s END")} AS twice FROM a""",
)
def t08_fields(spark, sf):
    fields = v.hourly(spark, sf).select("ts", "channel", F.array("value", F.col("value") * 2).alias("values"))
    out = tx.accumulate_fields(fields, 6, ["channel"], chunk_hours=48)
    return out.select(
        stamp("ts").alias("ts"), "channel", r6(F.col("values")[0]).alias("value"),
        r6(F.col("accumulated")[0]).alias("accumulated"), r6(F.col("accumulated")[1]).alias("twice"),
    )


@query(
    "t09_every_kth_step",
    f"""{with_views("hourly")},
r AS (SELECT date_trunc('day', ts) AS run, channel, ts, value,
             row_number() OVER (PARTITION BY date_trunc('day', ts), channel ORDER BY ts) - 1 AS s FROM hourly)
SELECT {qstamp("run")} AS run, channel, {qstamp("ts")} AS ts, {q6("value")} AS value, CAST((s - 2) // 2 AS INTEGER) AS slot
FROM r WHERE s >= 2 AND s % 2 = 0 AND s < 12""",
)
def t09(spark, sf):
    steps = v.hourly(spark, sf).withColumn("run", F.date_trunc("day", "ts"))
    out = tx.every_kth_step(steps, ["run", "channel"], "ts", 2, 2, 5)
    return out.select(
        stamp("run").alias("run"), "channel", stamp("ts").alias("ts"), r6("value").alias("value"), "slot"
    )


# A persistence forecast: the value of a day is forecast for one, two and three days later.
FORECAST = """pairs AS (
  SELECT p.ts + to_days(lead) AS valid_ts, lead, p.channel, p.i, p.value AS pred, t.value AS truth
  FROM climate p, (SELECT unnest([1, 2, 3]) AS lead) l
  JOIN climate t ON t.ts = p.ts + to_days(lead) AND t.channel = p.channel AND t.i = p.i)"""

# Seven rows from pole to pole, 30 degrees apart; a pole row covers no area.
WEIGHTS = """area AS (SELECT CAST(k AS INTEGER) AS i, 90 - k * 30 AS lat, CASE WHEN k IN (0, 6) THEN 0 ELSE cos(radians(90 - k * 30)) END AS a FROM range(0, 7) r(k)),
wt AS (SELECT i, lat, a / (SELECT avg(a) FROM area) AS weight FROM area WHERE i IN (SELECT i FROM climate))"""


def _forecast(spark, sf):
    truth = v.climate(spark, sf)
    pred = truth.withColumn("lead", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        (F.col("ts") + F.make_dt_interval(F.col("lead"))).alias("valid_ts"), "lead", "channel", "i", "value"
    )
    return tx.forecast_truth_pairs(pred, truth, ["channel", "i"])


def _persisted(truth):
    """Every field as its own forecast for the next three days."""
    return truth.withColumn("lead", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn(
        "valid_ts", F.col("ts") + F.make_dt_interval(F.col("lead"))
    )


def _forecast_fields(spark, sf):
    truth = v.climate_fields(spark, sf)
    return tx.forecast_fields(_persisted(truth).drop("ts"), truth, ["channel"])


@query(
    "t10_forecast_truth_pairs",
    f"""{with_views("climate")}, {FORECAST}
SELECT {qstamp("valid_ts")} AS valid_ts, lead, channel, i, {q6("pred")} AS pred, {q6("truth")} AS truth FROM pairs""",
)
def t10(spark, sf):
    return _forecast(spark, sf).select(
        stamp("valid_ts").alias("valid_ts"), "lead", "channel", "i", r6("pred").alias("pred"), r6("truth").alias("truth")
    )


@query(
    "t10_forecast_truth_fields",
    f"""{with_views("climate")}, {FORECAST}
SELECT {qstamp("valid_ts")} AS valid_ts, lead, channel, i, {q6("pred")} AS pred, {q6("truth")} AS truth FROM pairs""",
)
def t10_fields(spark, sf):
    columns = v.climate(spark, sf).withColumn("j", F.lit(0))
    truth = cells_to_field(columns, ["ts", "channel"], v.CLIMATE_ROWS, 1)
    pairs = tx.forecast_truth_fields(_persisted(truth), truth, ["channel"]).dropna(subset=["pred", "truth"])
    return pairs.select(
        stamp("valid_ts").alias("valid_ts"), "lead", "channel", "i", r6("pred").alias("pred"), r6("truth").alias("truth")
    )


@query(
    "t11_lead_curriculum",
    """WITH s AS (SELECT event_id + 1 AS iteration, greatest(((event_id + 1 + 10) // 10) % 10, 1) AS s FROM events),
p AS (SELECT iteration, CASE WHEN iteration % 2 = 1 THEN greatest(((iteration + 1) // 2) % s, 1) ELSE s END AS stage FROM s)
SELECT iteration, CAST(stage AS BIGINT) AS stage, CAST((stage - 1) * 2 AS BIGINT) AS first, CAST(stage * 2 AS BIGINT) AS last FROM p""",
)
def t11(spark, sf):
    its = v.table(spark, sf, "events").select((F.col("event_id") + 1).alias("iteration"))
    return tx.lead_curriculum(its, 10, 20, 2)


@query(
    "m03_weighted_rmse",
    f"""{with_views("climate")}, {FORECAST}, {WEIGHTS},
t AS (SELECT lead, channel, valid_ts, sqrt(sum(weight * (pred - truth) * (pred - truth)) / nullif(sum(weight), 0)) AS r
      FROM pairs JOIN wt USING (i) GROUP BY ALL)
SELECT lead, channel, {q6("avg(r)")} AS wrmse, count(r) AS n_times FROM t GROUP BY ALL""",
)
def m03(spark, sf):
    out = sc.weighted_rmse_fields(_forecast_fields(spark, sf), v.CLIMATE_ROWS, 1, ["lead", "channel"])
    return out.select("lead", "channel", r6("wrmse").alias("wrmse"), "n_times")


CENTRED = """centred AS (SELECT p.*, clim FROM pairs p JOIN clim k ON k.md = strftime(valid_ts, '%m-%d') AND k.channel = p.channel AND k.i = p.i)"""


def _centred(spark, sf):
    return tx.climatology_fields(_forecast_fields(spark, sf), _clim(spark, sf), ["channel"], ts="valid_ts")


@query(
    "m04_anomaly_correlation",
    f"""{with_views("climate")}, {FORECAST}, {WEIGHTS}, {CLIM}, {CENTRED},
t AS (SELECT lead, channel, valid_ts, sum(weight * (pred - clim) * (truth - clim)) AS ab,
        sqrt(sum(weight * (pred - clim) * (pred - clim)) * sum(weight * (truth - clim) * (truth - clim))) AS norm
      FROM centred JOIN wt USING (i) GROUP BY ALL)
SELECT lead, channel, {q6("avg(CASE WHEN norm > 0 THEN ab / norm END)")} AS acc, count(CASE WHEN norm > 0 THEN ab / norm END) AS n_times FROM t GROUP BY ALL""",
)
def m04(spark, sf):
    out = sc.anomaly_correlation_fields(_centred(spark, sf), v.CLIMATE_ROWS, 1, ["lead", "channel"])
    return out.select("lead", "channel", r6("acc").alias("acc"), "n_times")


@query(
    "m05_bias_activity",
    f"""{with_views("climate")}, {FORECAST}, {CLIM}, {CENTRED}
SELECT lead, channel, {q6("avg(pred - truth)")} AS bias, {q6("stddev_pop(pred - clim)")} AS activity_pred,
 {q6("stddev_pop(truth - clim)")} AS activity_truth FROM centred GROUP BY ALL""",
)
def m05(spark, sf):
    out = sc.bias_activity_fields(_centred(spark, sf), v.CLIMATE_ROWS, 1, ["lead", "channel"])
    return out.select("lead", "channel", *[r6(x).alias(x) for x in ("bias", "activity_pred", "activity_truth")])


@query(
    "g11_latitude_weights",
    f"""{with_views("climate")}, {WEIGHTS} SELECT i, CAST(lat AS DOUBLE) AS lat, {q6("weight")} AS weight FROM wt""",
)
def g11(spark, sf):
    out = sp.latitude_weights(v.climate(spark, sf), v.CLIMATE_ROWS)
    return out.select("i", "lat", r6("weight").alias("weight"))
