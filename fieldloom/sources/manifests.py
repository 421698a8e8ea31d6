"""What should exist, what to request, and what is still missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Channel = tuple[str, float | None]


def channel_list(pressure: Sequence[str], levels: Sequence[float], single: Sequence[str]) -> list[Channel]:
    """(variable, level) in channel order; single-level variables have no level."""
    return [(v, float(lv)) for v in pressure for lv in levels] + [(v, None) for v in single]


def _literal(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def field_manifest(times: DataFrame, channels: Sequence[Channel], layout: str = "arrays",
                   ts: str = "ts", root: str = "", clock_format: str = "HH:mm:ss") -> DataFrame:
    """The path expected for every time and channel.

    ``arrays``: one file per channel, ``YYYY/<date>/<time>-<var>-<level>.npy``, with
    ``single/`` in front and no level for single-level variables.
    ``files``: one pressure and one single-level file per time.

    The channel list is configuration, so it is exploded from a literal; the times stay
    where they are.
    """
    day, clock = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, clock_format)
    year = F.date_format(ts, "yyyy")
    if layout == "files":
        stamp = F.concat(day, F.lit("T"), clock)
        return times.withColumn("kind", F.explode(_literal(["pressure", "single"]))).withColumn(
            "path", F.concat(F.lit(root), year, F.lit("/"), stamp, F.lit("_"), F.col("kind"), F.lit(".nc"))
        )
    if layout != "arrays":
        raise ValueError(f"unknown layout {layout!r}")
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("channel_idx"),
                F.lit(v).alias("variable"),
                F.lit(lv).cast("double").alias("level"),
                F.lit("single/" if lv is None else "").alias("head"),
                F.lit(f"-{v}.npy" if lv is None else f"-{v}-{lv}.npy").alias("tail"),
            )
            for k, (v, lv) in enumerate(channels)
        ]
    )
    rows = times.withColumn("_c", F.explode(entries))
    path = F.concat(F.lit(root), F.col("_c.head"), year, F.lit("/"), day, F.lit("/"), clock, F.col("_c.tail"))
    return rows.withColumns(
        {"channel_idx": F.col("_c.channel_idx"), "variable": F.col("_c.variable"),
         "level": F.col("_c.level"), "path": path}
    ).drop("_c")


def request_manifest(years: DataFrame, months: Sequence[int], days: Sequence[int], hours: Sequence[int],
                     variables: Sequence[str], levels: Sequence[int] | None = None, year: str = "year") -> DataFrame:
    """Every combination of the request's dimensions, dates that do not exist left out.

    Without ``levels`` the request is for single-level variables and has no level dimension.

    ``years`` is a table; the other dimensions are configuration and are exploded from
    literals, valid days before hours, variables and levels.
    """
    y, m, d = F.col(year), F.col("month"), F.col("day")
    rows = (
        years.withColumn("month", F.explode(_literal([int(x) for x in months])))
        .withColumn("day", F.explode(_literal([int(x) for x in days])))
        .where(d <= F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1)))))
        .withColumn("hour", F.explode(_literal([int(x) for x in hours])))
        .withColumn("variable", F.explode(_literal(list(variables))))
    )
    return _with_levels(rows, levels)


def _with_levels(rows: DataFrame, levels: Sequence[int] | None) -> DataFrame:
    if levels is None:
        return rows
    if not levels:
        raise ValueError("no levels given; leave them out for single-level variables")
    return rows.withColumn("level", F.explode(_literal([int(x) for x in levels])))


def request_for_times(times: DataFrame, variables: Sequence[str], levels: Sequence[int] | None = None,
                      ts: str = "ts") -> DataFrame:
    """S02 override: the request with its year, month, day and time taken from a timestamp."""
    rows = (
        times.withColumns(
            {
                "year": F.date_format(ts, "yyyy"),
                "month": F.date_format(ts, "MM"),
                "day": F.date_format(ts, "dd"),
                "time": F.date_format(ts, "HH:mm:ss"),
            }
        )
        .withColumn("variable", F.explode(_literal(list(variables))))
    )
    return _with_levels(rows, levels)


def completeness_check(expected: DataFrame, actual: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """An object is complete iff its local size equals the expected one.

    A missing object has size 0.  Everything else must be fetched again.  A path listed
    more than once counts with its largest size.
    """
    # One row per path, so that a path listed many times cannot multiply in the join.
    local = actual.groupBy(path).agg(F.max(size).alias("local_size"))
    return (
        expected.join(local, path, "left")
        .withColumn("local_size", F.coalesce("local_size", F.lit(0).cast("long")))
        .withColumn("complete", F.col("local_size") == F.col(size))
    )
