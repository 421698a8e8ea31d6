"""Reading array files, listing, naming by content, splits."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .npy import npy_values


def decode_npy(files: DataFrame, channels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Per-channel ``.npy`` contents as packed fields at their channel's index.

    ``files`` has (path, content), ``channels`` (channel_idx, variable, level).  Paths follow the
    ``arrays`` layout of the field manifest, with any character between hours, minutes and
    seconds.  One file is one row in and one packed row out; a file whose shape differs
    from ``shape`` is an error, never resized (see :func:`npy_values`).  A channel that ``channels`` lacks has a NULL
    index.
    """
    h, w = shape
    decoded = npy_values(files.select("path", "content"), shape)
    name = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2}/[^/]+)\.npy$", 1)
    stamp = F.regexp_replace(F.substring(name, 1, 19), r"^(.{10}).(..).(..).(..)$", "$1 $2:$3:$4")
    level = F.regexp_extract(name, r"-([0-9.]+)$", 1)
    parsed = decoded.select(
        F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.regexp_extract(name, r"^.{19}-([^-]+)", 1).alias("variable"),
        F.when(level != "", level.cast("double")).alias("level"),
        "values",
    )
    dim = channels.select("channel_idx", F.col("variable").alias("_v"), F.col("level").alias("_l"))
    match = (F.col("variable") == F.col("_v")) & F.col("level").eqNullSafe(F.col("_l"))
    return parsed.join(dim, match, "left").select(
        "ts", "channel_idx", F.lit(h).alias("h"), F.lit(w).alias("w"), "values"
    )


def scan_npy_fields(spark: SparkSession, path: str, channels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """:func:`decode_npy` of all ``.npy`` files under a folder.

    Hadoop's local file system cannot open names with colons; object stores can.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.npy")
        .load(path)
    )
    return decode_npy(files, channels, shape)


def filter_listing(files: DataFrame, suffixes: Sequence[str] = (), recursive: bool = False,
                   case_sensitive: bool = True, path: str = "path") -> DataFrame:
    """Relative paths with one of the suffixes, hidden files left out, sorted."""
    name = F.substring_index(F.col(path), "/", -1)
    keep = ~name.startswith(".")
    if not recursive:
        keep = keep & ~F.col(path).contains("/")
    if suffixes:
        text = F.col(path) if case_sensitive else F.lower(path)
        wanted = [s if case_sensitive else s.lower() for s in suffixes]
        hits = [text.endswith(s) for s in wanted]
        any_hit = hits[0]
        for hit in hits[1:]:
            any_hit = any_hit | hit
        keep = keep & any_hit
    return files.where(keep).orderBy(path)


#: What a task says of the entries of a folder.
ENTRY = "path string, size long, folder boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of every folder of a batch, by Arrow's file systems."""
    kinds = [pa.string(), pa.int64(), pa.bool_()]
    names = ["path", "size", "folder"]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, folder = pafs.LocalFileSystem(), path
            if "://" in path:
                head, tail = re.match(r"([^:]+://[^/]*)(.*)", path, re.S).groups()
                system, folder = pafs.FileSystem.from_uri(head + quote(tail))
            prefix = path[: len(path) - len(folder)] if path.endswith(folder) else ""
            found = system.get_file_info(pafs.FileSelector(folder, recursive=False))
            rows = [(prefix + x.path, x.size, x.type == pafs.FileType.Directory) for x in found if x.type != pafs.FileType.NotFound]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def walk_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """All files under a folder as (path, size), whatever their names; paths as the file system has them.

    Tasks list folders side by side, one level after the other: a job per level of depth, a
    checkpointed row per entry, nothing but the folders' number on the driver.  Works for the file
    systems that Arrow knows (local, hdfs, s3, gs).  Links to folders are followed.
    """
    width = spark.sparkContext.defaultParallelism
    root = re.sub(r"^file:(//[^/]*)?", "", root)
    root = root if "://" in root else os.path.abspath(root)
    folders = spark.range(1).select(F.lit(root.rstrip("/") or "/").alias("path"))
    files = None
    while True:
        level = checkpointed(folders.repartition(width, "path").mapInArrow(_entries, ENTRY))
        found = level.where("NOT folder").select("path", "size")
        files = found if files is None else files.unionAll(found)
        folders = level.where("folder").select("path")
        if not recursive or folders.isEmpty():
            return files


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str] = (), recursive: bool = False,
               case_sensitive: bool = True, through: str = "tasks") -> DataFrame:
    """List a folder as (path, size), sorted, paths relative to it.

    Files whose own names begin with a dot are left out, folders of that kind are entered.  ``through``
    is ``tasks`` (:func:`walk_files`), or ``spark`` for file systems that only Spark's readers can
    open; those skip names that begin with ``_`` and folders that begin with a dot as well.  No file
    is opened either way.
    """
    if through == "tasks":
        files = walk_files(spark, root, recursive)
    elif through == "spark":
        source = spark.read.format("binaryFile").option("recursiveFileLookup", "true" if recursive else "false")
        files = source.load(root).select("path", F.col("length").alias("size"))
    else:
        raise ValueError("through must be 'tasks' or 'spark'")
    return filter_listing(files.withColumn("path", relative_path(F.col("path"), root)), suffixes, recursive, case_sensitive)


def relative_path(path: Column, root: str) -> Column:
    """A path without its root, which is taken off as a prefix, once.

    Spark lists resolved URIs (``file:/data/x``) whatever form the root was given in, so a scheme
    and authority are ignored on both sides.  A relative root is resolved against the working folder.
    """
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    base = os.path.abspath(base) if base == root and not os.path.isabs(base) else "/" + base.strip("/")
    return F.when(plain.startswith(base.rstrip("/") + "/"), F.substr(plain, F.lit(len(base.rstrip("/")) + 2))).otherwise(plain)


def content_hash_name(blobs: DataFrame, n: int = 8, name: str = "name", content: str = "content",
                      extension: str = "") -> DataFrame:
    """Publish a blob as ``<name>-<first n hex digits of its SHA-256>``."""
    digest = F.substring(F.sha2(content, 256), 1, n)
    return blobs.withColumn("published", F.concat(F.col(name), F.lit("-"), digest, F.lit(extension)))


def split_listing(files: DataFrame, split: str, path: str = "path") -> DataFrame:
    """The files directly inside the split's folder, sorted."""
    folder = F.regexp_extract(path, r"(?:^|/)([^/]+)/[^/]+$", 1)
    return files.where(folder == split).orderBy(path)
