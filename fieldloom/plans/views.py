"""The shared tables seen as fields, symbols, observations, runs and blobs.

Each Spark view has an SQL twin as a common table expression in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import field_to_cells, split_tensor

CHANNELS, SIDE = 4, 4
PLANE = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def latent_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Packed latents: four channels of 4x4 per vector."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), "embedding")
    return split_tensor(vectors, "embedding", CHANNELS, SIDE, SIDE)


def latent(spark: SparkSession, sf: str) -> DataFrame:
    return field_to_cells(latent_fields(spark, sf), ["sample", "c"], "y")


def symbol_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = latent_fields(spark, sf)
    return fields.withColumn("values", F.transform("values", lambda y: F.rint(y * 20.0).cast("int")))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return field_to_cells(symbol_fields(spark, sf), ["sample", "c"], "sym")


def recon_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The latents after rounding to twentieths: a reconstruction of ``latent_fields``."""
    fields = latent_fields(spark, sf)
    return fields.withColumn("values", F.transform("values", lambda y: F.rint(y * 20.0) / 20.0))


def plane_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as one 8x8 field; the label is its channel."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample"),
        F.col("label").alias("channel"),
        F.lit(PLANE).alias("h"),
        F.lit(PLANE).alias("w"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def plane(spark: SparkSession, sf: str) -> DataFrame:
    return field_to_cells(plane_fields(spark, sf), ["sample", "channel"])


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly observations, unique per (ts, channel, cell)."""
    return (
        table(spark, sf, "events")
        .groupBy(
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
            F.col("event_type").alias("channel"),
            F.col("user_id").alias("cell"),
        )
        .agg(F.avg("value").alias("value"))
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means per channel, unique per (ts, channel)."""
    return (
        table(spark, sf, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("channel"))
        .agg(F.avg("value").alias("value"))
    )


def climate(spark: SparkSession, sf: str) -> DataFrame:
    """Daily values per channel and grid row, rows counted from 0."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_shipdate").alias("ts"),
            F.col("l_returnflag").alias("channel"),
            (F.col("l_linenumber") - 1).alias("i"),
        )
        .agg(F.avg("l_extendedprice").alias("value"))
    )


CLIMATE_ROWS = 7


def climate_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The same as packed fields of one column; rows without a value are NULL."""
    at = F.col("l_linenumber") - 1
    values = [F.avg(F.when(at == k, F.col("l_extendedprice"))) for k in range(CLIMATE_ROWS)]
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("channel"))
        .agg(F.array(*values).alias("values"))
        .select("ts", "channel", F.lit(CLIMATE_ROWS).alias("h"), F.lit(1).alias("w"), "values")
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Codec runs: rate and quality per (codec, quality, item)."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("codec"),
            F.col("l_linenumber").alias("qp"),
            F.col("l_suppkey").alias("item"),
        )
        .agg((F.avg("l_discount") + 0.01).alias("bpp"), F.avg("l_quantity").alias("psnr"))
    )


def metric_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs in long form, one row per metric."""
    long = F.explode(
        F.array(
            F.struct(F.lit("bpsp").alias("metric"), F.col("bpp").alias("value")),
            F.struct(F.lit("psnr-rgb").alias("metric"), F.col("psnr").alias("value")),
            F.struct(F.lit("ms-ssim-rgb").alias("metric"), (F.col("psnr") / 100).alias("value")),
        )
    ).alias("_m")
    return runs(spark, sf).select("codec", "qp", "item", long).select(
        "codec", "qp", "item", "_m.metric", "_m.value"
    )


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat_ws("/", "source", F.concat("doc_id", F.lit("."), "lang")).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.encode("text", "UTF-8").alias("content"),
    )


def moments_tensor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample"), F.col("embedding").alias("values")
    )


CTE = {
    "latent": """latent AS (
  SELECT sample, CAST(pos // 16 AS INTEGER) AS c, CAST((pos % 16) // 4 AS INTEGER) AS i,
         CAST(pos % 4 AS INTEGER) AS j, CAST(x AS DOUBLE) AS y
  FROM (SELECT vec_id AS sample, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings))""",
    "symbols": """symbols AS (
  SELECT sample, c, i, j, CAST(round_even(y * CAST(20 AS DOUBLE), 0) AS INTEGER) AS sym FROM latent)""",
    "recon": """recon AS (
  SELECT sample, c, i, j, y AS orig, round_even(y * CAST(20 AS DOUBLE), 0) / CAST(20 AS DOUBLE) AS recon FROM latent)""",
    "plane": """plane AS (
  SELECT sample, channel, CAST(pos // 8 AS INTEGER) AS i, CAST(pos % 8 AS INTEGER) AS j, CAST(x AS DOUBLE) AS value
  FROM (SELECT vec_id AS sample, label AS channel, unnest(embedding) AS x,
               unnest(range(0, len(embedding))) AS pos FROM embeddings))""",
    "obs": """obs AS (
  SELECT date_trunc('hour', ts) AS ts, event_type AS channel, user_id AS cell, avg(value) AS value
  FROM events GROUP BY ALL)""",
    "hourly": """hourly AS (
  SELECT date_trunc('hour', ts) AS ts, event_type AS channel, avg(value) AS value FROM events GROUP BY ALL)""",
    "climate": """climate AS (
  SELECT l_shipdate AS ts, l_returnflag AS channel, CAST(l_linenumber - 1 AS INTEGER) AS i,
         avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)""",
    "runs": """runs AS (
  SELECT l_returnflag AS codec, l_linenumber AS qp, l_suppkey AS item,
         avg(l_discount) + CAST(0.01 AS DOUBLE) AS bpp, avg(l_quantity) AS psnr FROM lineitem GROUP BY ALL)""",
    "metric_runs": """metric_runs AS (
  SELECT codec, qp, item, 'bpsp' AS metric, bpp AS value FROM runs
  UNION ALL SELECT codec, qp, item, 'psnr-rgb', psnr FROM runs
  UNION ALL SELECT codec, qp, item, 'ms-ssim-rgb', psnr / CAST(100 AS DOUBLE) FROM runs)""",
    "blobs": """blobs AS (
  SELECT concat(source, '/', doc_id, '.', lang) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size,
         encode(text) AS content FROM documents)""",
    "moments": """moments AS (
  SELECT a.sample, a.c, a.i, a.j, a.y AS mean,
         least(greatest(b.y, CAST(-30 AS DOUBLE)), CAST(20 AS DOUBLE)) AS logvar
  FROM latent a JOIN latent b ON a.sample = b.sample AND b.c = a.c + 2 AND a.i = b.i AND a.j = b.j
  WHERE a.c < 2)""",
}


def with_views(*names: str) -> str:
    """The WITH clause that defines the named views (list what they build on first)."""
    return "WITH " + ",\n".join(CTE[n] for n in names)
