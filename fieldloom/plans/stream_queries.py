"""W rows: the event table read as a stream and drained, against its batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import as_instant, as_wall
from ..operators import statistics as st
from ..sizing import reused
from ..streaming import scores as ss
from ..streaming import units as un
from ..session import shared_dir
from . import views as v
from .registry import q6, qstamp, query, r6, stamp


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a file stream with a TIMESTAMP event time."""
    schema = v.table(spark, sf, "events").schema
    # A glob, because a file source reads folders; it matches the one file.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return stream.withColumn("ts", as_instant(F.col("ts")))


# The watermark is one hour behind the newest event; a sample times out two hours after
# its hour.  Complete samples appear whatever their age.
ASSEMBLED = f"""WITH u AS (SELECT date_trunc('hour', ts) AS h, count(DISTINCT event_type) AS n FROM events GROUP BY 1),
m AS (SELECT date_trunc('hour', max(ts)) AS newest FROM events)
SELECT {qstamp("h")} AS ts, CAST(n AS BIGINT) AS arrived, n >= 5 AS complete FROM u, m
WHERE n >= 5 OR h + INTERVAL 2 HOUR <= newest - INTERVAL 1 HOUR"""


@query("w01_assemble_stream", ASSEMBLED)
def w01(spark, sf):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, un.STATE_STORE)
    try:
        units = event_stream(spark, sf).select(
            F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("unit")
        )
        out = ss.drain(un.assemble_stream(units, 5, 2))
    finally:
        spark.conf.set(provider, before)
    return out.select(stamp(as_wall(F.col("ts"))).alias("ts"), "arrived", "complete")


STATS = "stats AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1)"


@query(
    "w02_standardize_stream",
    f"""WITH {STATS} SELECT event_id, event_type, {q6("(value - mean) / std")} AS value FROM events JOIN stats USING (event_type)""",
)
def w02(spark, sf):
    stats = st.channel_stats(v.table(spark, sf, "events"), ["event_type"])
    scaled = ss.standardize_stream(event_stream(spark, sf), stats, channel="event_type")
    out = ss.drain(scaled.select("event_id", "event_type", "value"))
    return out.select("event_id", "event_type", r6("value").alias("value"))


@query(
    "w03_running_stats_stream",
    f"""SELECT event_type, count(*) AS n, {q6("avg(value)")} AS mean, {q6("stddev_pop(value)")} AS std, CAST(0 AS BIGINT) AS n_null FROM events GROUP BY 1""",
)
def w03(spark, sf):
    out = ss.drain(ss.running_stats_stream(event_stream(spark, sf), ["event_type"]), "complete")
    return out.select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"), "n_null")


@query(
    "w03_stored_stats",
    f"""SELECT event_type, count(*) AS n, {q6("avg(value)")} AS mean, {q6("stddev_pop(value)")} AS std, CAST(0 AS BIGINT) AS n_null FROM events GROUP BY 1""",
)
def w03_stored(spark, sf):
    base = shared_dir(spark, "stats")
    writer = ss.keep_partial_stats(event_stream(spark, sf), f"{base}/parts", f"{base}/progress", ["event_type"])
    writer.trigger(availableNow=True).start().awaitTermination()
    return ss.stored_stats(spark, f"{base}/parts", ["event_type"]).select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"), "n_null")


@query(
    "w04_windowed_error_stream",
    f"""WITH p AS (SELECT ts, event_type, value, round_even(value, 0) AS recon FROM events),
w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type, avg((value - recon) * (value - recon)) AS mse, count(*) AS n
  FROM p GROUP BY ALL)
SELECT {qstamp("s")} AS start, event_type, {q6("mse")} AS mse, n FROM w
WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def w04(spark, sf):
    pairs = event_stream(spark, sf).withColumns({"orig": F.col("value"), "recon": F.rint("value")})
    out = ss.drain(ss.windowed_error_stream(pairs, "6 hours", keys=["event_type"]))
    return out.select(stamp(as_wall(F.col("start"))).alias("start"), "event_type", r6("mse").alias("mse"), "n")
