"""Session helpers for local runs, and the shared folder used for durable state."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used by local sessions where ``spark.checkpoint.dir`` is unset.
DEFAULT_SHARED = "/tmp/checkpoints"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_base(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or the folder set on the context.

    Only a local session may do without either: elsewhere a default path could be another
    folder on every machine, so that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = DEFAULT_SHARED
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder, which every executor sees."""
    return os.path.join(shared_base(spark), f"{purpose}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder, where lost executors do not matter."""
    shared_base(df.sparkSession)
    return df.checkpoint()
