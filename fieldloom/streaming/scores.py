"""Normalising, summarising and scoring a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.numeric import present
from ..operators.statistics import channel_stats, merge_stats, standardize
from ..session import shared_dir


def standardize_stream(cells: DataFrame, stats: DataFrame, channel: str = "channel_idx",
                       value: str = "value") -> DataFrame:
    """N04 on a stream; the statistics are a static table, read anew and joined in every batch."""
    return standardize(cells, stats, channel=channel, value=value)


def running_stats_stream(cells: DataFrame, keys: Sequence[str] = ("channel_idx",), value: str = "value") -> DataFrame:
    """N01 kept up to date; state is one row per channel.  For update or complete mode."""
    return channel_stats(cells, keys, value)


def keep_partial_stats(cells: DataFrame, path: str, progress: str, keys: Sequence[str] = ("channel_idx",),
                       value: str = "value") -> DataStreamWriter:
    """W03 as a store of increments: every batch leaves its own N01 rows under ``path``.

    A batch that runs again after a failure replaces what it left before, as its folder carries its
    number; so nothing is lost or counted twice, and no state is kept anywhere else.  Give the
    returned writer a trigger and start it; :func:`stored_stats` merges what is there.
    """

    def keep(batch: DataFrame, number: int) -> None:
        channel_stats(batch, keys, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.option("checkpointLocation", progress).foreachBatch(keep)


def stored_stats(spark: SparkSession, path: str, keys: Sequence[str] = ("channel_idx",)) -> DataFrame:
    """The statistics over all batches that :func:`keep_partial_stats` has stored."""
    return merge_stats(spark.read.parquet(path).drop("batch"), keys)


def windowed_error_stream(pairs: DataFrame, size: str, slide: str | None = None, watermark: str = "1 hour",
                          keys: Sequence[str] = (), ts: str = "ts", orig: str = "orig",
                          recon: str = "recon") -> DataFrame:
    """Mean squared error per event-time window over the pairs present, closed by the watermark."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    gap = present(orig) - present(recon)
    return (
        pairs.withWatermark(ts, watermark)
        .groupBy(window.alias("window"), *keys)
        .agg(F.avg(gap * gap).alias("mse"), F.count(gap).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "mse", "n")
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input and return what the stream wrote.

    Appended rows go to a parquet sink.  ``complete`` results are written per batch, and
    the newest batch is returned.  Output and progress live in the shared folder.
    """
    spark: SparkSession = stream.sparkSession
    base = shared_dir(spark, "stream")
    out = f"{base}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    newest = {"batch": -1}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        newest["batch"] = max(newest["batch"], number)

    writer.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    if newest["batch"] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={newest['batch']}")
