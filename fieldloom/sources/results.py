"""Result documents, ``{name, description, results: {metric: [..]}}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ratio_to_db

DOC = "name string, description string, results map<string,array<double>>"
FLAT = "map<string,string>"


def parse_result_docs(docs: DataFrame, text: str = "text", fallback_name: str | None = None) -> DataFrame:
    """One row per document with its name and its metric arrays.

    The ``results`` wrapper is optional: without it the metrics stand at the top level.
    A document without a name takes the value of column ``fallback_name``.
    """
    doc = F.from_json(text, DOC)
    flat = F.from_json(text, FLAT)
    arrays = F.map_filter(flat, lambda _, v: F.ltrim(v).startswith("["))
    bare = F.transform_values(arrays, lambda _, v: F.from_json(v, "array<double>"))
    rows = docs.withColumns({"_d": doc, "_m": bare})
    name = F.col("_d.name") if fallback_name is None else F.coalesce("_d.name", fallback_name)
    return rows.select(
        name.alias("codec"),
        F.col("_d.description").alias("description"),
        F.coalesce("_d.results", "_m").alias("results"),
    )


def read_result_docs(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder of JSON documents, named after the file where unnamed."""
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("text"),
        F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("stem"),
    )
    return parse_result_docs(docs, fallback_name="stem")


def result_runs(docs: DataFrame) -> DataFrame:
    """The metric arrays in long form, (codec, metric, qp = position, value)."""
    return docs.select("codec", F.explode("results").alias("metric", "_v")).select(
        "codec", "metric", F.posexplode("_v").alias("qp", "value")
    )


def rd_points(docs: DataFrame, metric: str, rate: str = "bpsp") -> DataFrame:
    """Rate and metric aligned by position; the shorter array is padded with NULL.

    ``psnr`` and ``ms-ssim`` mean their ``-rgb`` variant; similarity is given in
    decibels.  A document without the metric is marked ``available = false``.
    """
    key = f"{metric}-rgb" if metric in ("psnr", "ms-ssim") else metric
    xs, ys = F.try_element_at("results", F.lit(rate)), F.try_element_at("results", F.lit(key))
    rows = docs.select("codec", xs.alias("x"), ys.alias("y")).withColumn(
        "available", F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    both = F.when(F.col("available"), F.arrays_zip("x", "y"))
    points = rows.select("codec", "available", F.posexplode_outer(both).alias("qp", "_p"))
    y = ratio_to_db(F.col("_p.y")) if "ms-ssim" in key else F.col("_p.y")
    return points.select("codec", "available", "qp", F.col("_p.x").alias("x"), y.alias("y"))


def write_result_docs(runs: DataFrame, description: str = "") -> DataFrame:
    """One document per codec, each metric a list ordered by quality.

    ``runs`` has one row per (codec, qp, metric), i.e. averages over files, so a group
    holds one value per quality.
    """
    ordered = F.sort_array(F.collect_list(F.struct("qp", "value")))
    per_metric = runs.groupBy("codec", "metric").agg(F.transform(ordered, lambda r: r["value"]).alias("values"))
    docs = per_metric.groupBy("codec").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "values")))).alias("results")
    )
    body = F.struct(F.col("codec").alias("name"), F.lit(description).alias("description"), F.col("results"))
    return docs.select("codec", F.to_json(body).alias("text"))
