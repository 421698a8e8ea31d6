"""Packed fields on disk, partitioned by year and channel or co-located by key, and statistics documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("year", "channel_idx")


def write_fields(fields: DataFrame, path: str, files_per_partition: int = 1, mode: str = "error") -> None:
    """Write (ts, channel_idx, h, w, values) under ``year=/channel_idx=`` folders.

    Rows are gathered per folder before writing, so that tasks do not each leave a small
    file in every folder.  ``files_per_partition`` spreads one folder's rows over that
    many tasks; raise it for years that do not fit one task.
    """
    rows = fields.withColumn("year", F.year("ts"))
    spread = F.pmod(F.xxhash64("ts"), F.lit(files_per_partition))
    rows.repartition(*PARTITIONS, spread).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_fields(spark: SparkSession, path: str, first: str | None = None, last: str | None = None,
                channels: Sequence[int] | None = None) -> DataFrame:
    """Read packed fields of a date range (end day included) and of some channels.

    The range is also put on the ``year`` folder column, so other years and channels are
    never listed for reading, and the time predicate reaches the parquet scan.
    """
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz")).where(F.col("year") >= int(first[:4]))
    if last is not None:
        end = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
        df = df.where(F.col("ts") < end).where(F.col("year") <= int(last[:4]))
    if channels is not None:
        df = df.where(F.col("channel_idx").isin([int(c) for c in channels]))
    return df


def write_colocated(fields: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write packed fields as the bucketed table ``table`` at ``path`` and return it.

    Rows are dealt out once, by ``keys``, so a bucket is one file.  Tables with the same keys and number
    of buckets join on them without a shuffle: originals, reconstructions and truths that are
    scored again and again are moved only when they are written.
    """
    keys = list(keys)
    rows = fields.repartition(buckets, *keys).sortWithinPartitions(*keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    return fields.sparkSession.table(table)


def open_colocated(spark: SparkSession, table: str, path: str, schema: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Name what :func:`write_colocated` left at ``path`` in a session that does not know it yet."""
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{table}` ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


STATS_DOC = "mean map<string,string>, std map<string,string>, count bigint"


def parse_stats_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Statistics documents as rows (variable, level_idx, mean, std, n).

    A document holds, under ``mean`` and ``std``, a list per pressure variable in level
    order, a number per single-level variable, and a number ``<variable>_overall`` over
    all levels.  ``level_idx`` is NULL for the numbers.
    """
    doc = docs.select(F.from_json(text, STATS_DOC).alias("d"))
    rows = doc.select("d.count", F.col("d.std").alias("std"), F.explode("d.mean").alias("variable", "mean"))

    def as_list(c: Column) -> Column:
        one = F.array(c.cast("double"))
        return F.when(c.startswith("["), F.from_json(c, "array<double>")).otherwise(F.when(~c.startswith("["), one))

    rows = rows.withColumn("std", F.try_element_at("std", F.col("variable")))
    level = F.when(F.col("mean").startswith("["), F.col("_k"))
    return (
        rows.withColumn("_z", F.arrays_zip(as_list(F.col("mean")).alias("m"), as_list(F.col("std")).alias("s")))
        .select("variable", "mean", "count", F.posexplode("_z").alias("_k", "_v"))
        .select("variable", level.alias("level_idx"), F.col("_v")["m"].alias("mean"),
                F.col("_v")["s"].alias("std"), F.col("count").alias("n"))
    )


def read_stats_docs(spark: SparkSession, *paths: str) -> DataFrame:
    """Read statistics documents, one per file."""
    return parse_stats_docs(spark.read.text(list(paths), wholetext=True), "value")


def channel_statistics(stats: DataFrame, dim: DataFrame, levels: Sequence[float], norm_type: str = "channel") -> DataFrame:
    """The statistics of each channel: its own level's (``channel``) or its variable's (``overall``).

    Single-level channels always use their own number.
    """
    if norm_type not in ("channel", "overall"):
        raise ValueError("norm_type must be 'channel' or 'overall'")
    order = F.array(*[F.lit(float(x)) for x in levels])
    wanted = dim.withColumns(
        {
            "_idx": F.when(F.col("level").isNotNull() & F.lit(norm_type == "channel"),
                           (F.array_position(order, F.col("level")) - 1).cast("int")),
            "_var": F.when(F.col("level").isNotNull() & F.lit(norm_type == "overall"),
                           F.concat("variable", F.lit("_overall"))).otherwise(F.col("variable")),
        }
    )
    s = stats.select(F.col("variable").alias("_v"), F.col("level_idx").alias("_l"), "mean", "std", "n")
    match = (F.col("_var") == F.col("_v")) & F.col("_idx").eqNullSafe(F.col("_l"))
    return wanted.join(s, match).select("channel_idx", "name", "variable", "level", "n", "mean", "std")
