"""Channel dimension, selection, stacking and unit conversion."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clamp, hash_number, present
from .bands import BAND
from .layout import div, positions
from .packed import groups_of

#: Values of bands that are transposed together; a larger band is transposed alone.
TOGETHER = 1 << 20

# The pressure axis in hPa, from the ground up.
PRESSURE_LEVELS = (
    1000.0, 975.0, 950.0, 925.0, 900.0, 875.0, 850.0, 825.0, 800.0, 775.0, 750.0, 700.0, 650.0,
    600.0, 550.0, 500.0, 450.0, 400.0, 350.0, 300.0, 250.0, 225.0, 200.0, 175.0, 150.0, 125.0,
    100.0, 70.0, 50.0, 30.0, 20.0, 10.0, 7.0, 5.0, 3.0, 2.0, 1.0,
)

# Variables on pressure levels and on a single level, in channel order.
PRESSURE_VARIABLES = ("z", "q", "u", "v", "t", "r", "w")
SINGLE_VARIABLES = ("v10", "u10", "v100", "u100", "t2m", "tcc", "sp", "tp", "msl")

# Archive short codes and their long names, spelled as in the archive.
LONG_NAMES = {
    "Z_GDS0_ISBL": "geopotential",
    "U_GDS0_ISBL": "u_component_of_wind",
    "PV_GDS0_ISBL": "potential_vorticity",
    "T_GDS0_ISBL": "temperature",
    "V_GDS0_ISBL": "v_component_of_wind",
    "Q_GDS0_ISBL": "specific humidity",
    "W_GDS0_ISBL": "vertical_velocity",
    "VO_GDS0_ISBL": "vorticity",
    "O3_GDS0_ISBL": "ozone_mass_mixing_ratio",
    "D_GDS0_ISBL": "divergence",
    "R_GDS0_ISBL": "relative_humidity",
    "CLWC_GDS0_ISBL": "specific_cloud_liquid_water_conten",
    "CIWC_GDS0_ISBL": "specific_cloud_ice_water_content",
    "CC_GDS0_ISBL": "fraction_of_cloud_cover",
    "CRWC_GDS0_ISBL": "specific_rain_water_content",
    "CSWC_GDS0_ISBL": "specific_snow_water_content",
}


def channel_config(spark: SparkSession, pressure: Sequence[str] = PRESSURE_VARIABLES,
                   levels: Sequence[float] = PRESSURE_LEVELS,
                   single: Sequence[str] = SINGLE_VARIABLES) -> DataFrame:
    """A one-row configuration table for :func:`channel_dim`."""
    return spark.createDataFrame(
        [(list(pressure), [float(x) for x in levels], list(single))],
        "pressure array<string>, levels array<double>, single array<string>",
    )


def channel_dim(config: DataFrame) -> DataFrame:
    """Channel index, name, variable and level for each configuration row.

    Pressure variables vary slowest, levels fastest, single-level variables follow.
    """
    name = lambda v, lv: F.concat_ws("_", v, lv.cast("int").cast("string"))
    upper = F.flatten(
        F.transform(
            "pressure",
            lambda v: F.transform(
                "levels",
                lambda lv: F.struct(name(v, lv).alias("name"), v.alias("variable"), lv.alias("level")),
            ),
        )
    )
    surface = F.transform(
        "single",
        lambda v: F.struct(v.alias("name"), v.alias("variable"), F.lit(None).cast("double").alias("level")),
    )
    return config.select(F.posexplode(F.concat(upper, surface)).alias("channel_idx", "_c")).select(
        "channel_idx", "_c.name", "_c.variable", "_c.level"
    )


def select_levels(cells: DataFrame, wanted: Sequence[float], level: str = "level") -> DataFrame:
    """Keep the wanted levels and number them in the wanted order.

    An array position instead of a join; wanted levels that do not occur are simply
    absent (see :func:`missing_levels`).
    """
    order = F.array(*[F.lit(float(x)) for x in wanted])
    return cells.withColumn("level_idx", (F.array_position(order, F.col(level)) - 1).cast("int")).where(
        F.col(level).isin([float(x) for x in wanted])
    )


def missing_levels(cells: DataFrame, wanted: Sequence[float], level: str = "level") -> DataFrame:
    """The wanted levels that no row has."""
    spark = cells.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in wanted], f"{level} double")
    return asked.join(cells.select(level).distinct(), level, "left_anti")


def stack_channels(cells: DataFrame, keys: Sequence[str], channel: str = "channel_idx",
                   value: str = "value") -> DataFrame:
    """One row per ``keys`` with the values ordered by channel.

    A group has at most one row per channel; a repeated cell is an error.
    """
    pairs = F.sort_array(F.collect_list(F.struct(channel, value)))
    stacked = cells.groupBy(*keys).agg(pairs.alias("_p"))
    once = F.size(F.array_distinct(F.transform("_p", lambda x: x[channel]))) == F.size("_p")
    checked = F.when(once, F.col("_p")).otherwise(F.raise_error(F.lit("a cell is repeated")))
    return stacked.withColumn("_p", checked).select(
        *keys, F.col(f"_p.{channel}").alias("channels"), F.col(f"_p.{value}").alias("values")
    )


def stack_fields(fields: DataFrame, keys: Sequence[str], channel: str = "channel_idx", band: int = BAND) -> DataFrame:
    """C03 on packed fields: one row per cell (``keys``, ``i``, ``j``) with ``channels`` and ``values`` ordered by channel.

    Fields are cut into bands of ``band`` cells, the bands of one sample's channels meet in one task, and
    each is transposed there: a shuffle record per (sample, channel, band) instead of one per cell.
    A repeated channel and fields of different sizes are errors; missing cells stay missing.
    """
    keys = list(keys)
    kind = fields.schema["values"].dataType
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.size("values") - 1, F.lit(0)), F.lit(band))).alias("_first")
    rows = fields.where(F.size("values") > 0).select(*keys, channel, F.col("w").cast("int").alias("w"), "values", first)
    rows = rows.select(*keys, "_first", channel, "w", F.slice("values", F.col("_first") + 1, F.lit(band)).alias("_part"))
    rows = rows.repartition(*keys, "_first").sortWithinPartitions(*keys, "_first", channel)
    schema = T.StructType(
        [fields.schema[k] for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
        + [T.StructField("channels", T.ArrayType(fields.schema[channel].dataType)), T.StructField("values", kind)]
    )
    names = schema.names

    def shape(table: pa.Table) -> tuple[int, int, int, int]:
        """Channels, cells, width and first cell of one band."""
        sizes = table.column("_part").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        if len(set(table.column(channel).to_pylist())) < table.num_rows:
            raise ValueError("a channel is repeated")
        if (sizes != sizes[0]).any() or len(set(table.column("w").to_pylist())) > 1:
            raise ValueError("fields of one sample differ in size")
        return table.num_rows, int(sizes[0]), table.column("w")[0].as_py(), table.column("_first")[0].as_py()

    def turned(held: list[pa.Table], shapes: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        n, cells, w, first = (np.array(x, np.int64) for x in zip(*shapes))
        row, start = np.cumsum(n) - n, np.cumsum(n * cells) - n * cells
        by_cell = np.concatenate([s + np.arange(a * b).reshape(a, b).T.ravel() for s, a, b in zip(start, n, cells)])
        numbers = np.concatenate([r + np.tile(np.arange(a), b) for r, a, b in zip(row, n, cells)])
        at = np.concatenate([f + np.arange(b) for f, b in zip(first, cells)])
        w = np.repeat(w, cells)
        once = pa.array(np.repeat(row, cells))
        offsets = pa.array(np.append(0, np.cumsum(np.repeat(n, cells))).astype(np.int32))
        column = {c: table.column(c).combine_chunks() for c in (*keys, channel, "_part")}
        return pa.RecordBatch.from_arrays(
            [
                *[column[k].take(once) for k in keys],
                pa.array((at // w).astype(np.int32)),
                pa.array((at % w).astype(np.int32)),
                pa.ListArray.from_arrays(offsets, column[channel].take(pa.array(numbers))),
                pa.ListArray.from_arrays(offsets, column["_part"].flatten().take(pa.array(by_cell))),
            ],
            names,
        )

    def transpose(batches):
        held, shapes, size = [], [], 0
        for _, table in groups_of(batches, [*keys, "_first"]):
            held.append(table)
            shapes.append(shape(table))
            size += shapes[-1][0] * shapes[-1][1]
            if size >= TOGETHER:
                yield turned(held, shapes)
                held, shapes, size = [], [], 0
        if held:
            yield turned(held, shapes)

    return rows.mapInArrow(transpose, schema)


def unstack_channels(stacked: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inverse of C03, with the channel's name, NULL if the dimension lacks it."""
    long = stacked.select(*keys, F.explode(F.arrays_zip("channels", "values")).alias("_z")).select(
        *keys, F.col("_z.channels").alias("channel_idx"), F.col("_z.values").alias("value")
    )
    return long.join(dim.select("channel_idx", "name"), "channel_idx", "left")


def variable_names(codes: DataFrame, code: str = "code") -> DataFrame:
    """Add the long name of an archive code, NULL when unknown."""
    entries = [F.lit(x) for pair in LONG_NAMES.items() for x in pair]
    return codes.withColumn("long_name", F.try_element_at(F.create_map(*entries), F.col(code)))


def convert_units(cells: DataFrame, mode: str = "exact", variable: str = "variable",
                  value: str = "value") -> DataFrame:
    """Precipitation from metres to millimetres.

    ``exact`` converts the variable ``tp``; ``contains`` converts every variable whose
    name contains ``tp``.
    """
    if mode == "exact":
        hit: Column = F.col(variable) == "tp"
    elif mode == "contains":
        hit = F.col(variable).contains("tp")
    else:
        raise ValueError("mode must be 'exact' or 'contains'")
    return cells.withColumn(value, F.when(hit, F.col(value) * 1000.0).otherwise(F.col(value)))


def field_diff(original: DataFrame, reconstruction: DataFrame, keys: Sequence[str],
               channels: Sequence, channel: str = "channel_idx") -> DataFrame:
    """Original, reconstruction and absolute difference per cell of chosen channels.

    Both sides are ``fields``; they are joined packed, one row per field, and only then
    exploded, so the shuffle carries whole arrays instead of keyed cells.
    """
    chosen = F.col(channel).isin(list(channels))
    return pair_fields(original.where(chosen), reconstruction.where(chosen), keys).withColumn(
        "abs_diff", F.abs(F.col("orig") - F.col("recon"))
    )


def pair_fields(original: DataFrame, reconstruction: DataFrame, keys: Sequence[str],
                carry: Sequence[str] = ()) -> DataFrame:
    """Join two sets of packed fields on ``keys`` and explode the pairs into cells.

    Columns ``carry`` of the left side are kept.
    """
    left = original.select(*keys, *carry, "w", F.col("values").alias("_a"))
    right = reconstruction.select(*keys, F.col("values").alias("_b"))
    same = F.size("_a") == F.size("_b")
    at = F.when(same, F.col("_a")).otherwise(F.raise_error(F.lit("field shapes differ; regrid first")))
    pos, w = F.col("_pos"), F.col("w")
    return (
        left.join(right, list(keys))
        .select(*keys, *carry, "w", "_a", "_b", positions(at).alias("_pos"))
        .select(
            *keys,
            *carry,
            div(pos, w).cast("int").alias("i"),
            (pos % w).cast("int").alias("j"),
            F.get("_a", pos).alias("orig"),
            F.get("_b", pos).alias("recon"),
        )
    )


def sample_completeness(units: DataFrame, expected: int, keys: Sequence[str],
                        unit: Sequence[str] = ("channel_idx",)) -> DataFrame:
    """How many distinct units of each sample arrived, and whether it is ready.

    Duplicates are dropped first, spread over (keys, unit), so copies of one sample
    never meet in one task.
    """
    return (
        units.select(*keys, *unit)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("arrived"))
        .withColumn("ready", F.col("arrived") >= expected)
    )


def missing_units(units: DataFrame, dim: DataFrame, keys: Sequence[str],
                  unit: str = "channel_idx") -> DataFrame:
    """The (sample, unit) combinations that have not arrived.

    ``dim`` lists the expected units, as many as one sample has.  Only samples that are short are
    paired with them, each inside its own row.
    """
    arrived = units.select(*keys, unit).distinct()
    expected = dim.select(unit).distinct().agg(F.collect_list(unit).alias("_all"))  # one sample's units
    have = arrived.groupBy(*keys).agg(F.collect_list(unit).alias("_have"))
    lacking = F.array_except(expected.scalar(), F.col("_have"))
    return have.select(*keys, F.explode(lacking).alias(unit))


def split_moments(cells: DataFrame, half: int, keys: Sequence[str] = ("sample", "i", "j"),
                  channel: str = "c", value: str = "y") -> DataFrame:
    """C09 on cells: channel ``c`` is a mean, channel ``c + half`` its log variance."""
    picked = cells.groupBy(*keys, (F.col(channel) % half).cast("int").alias("_c")).agg(
        F.max(F.when(F.col(channel) < half, F.col(value))).alias("mean"),
        F.max(F.when(F.col(channel) >= half, F.col(value))).alias("logvar"),
    )
    return with_spread(picked.withColumnRenamed("_c", channel))


def split_moments_packed(tensors: DataFrame, keys: Sequence[str], channels: int, h: int, w: int,
                         values: str = "values") -> DataFrame:
    """C09 on packed samples (all channels in one array): both halves in one pass, no shuffle."""
    if channels % 2:
        raise ValueError("need an even number of channels")
    size, half = h * w, channels // 2 * h * w
    v, pos = F.col("_v"), F.col("_pos")
    whole = F.when(F.size(values) == 2 * half, F.col(values)).otherwise(
        F.raise_error(F.lit("sample does not have channels*h*w values"))
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("_pos")
    cells = tensors.select(*keys, whole.alias("_v")).select(*keys, "_v", at).select(
        *keys,
        div(pos, size).cast("int").alias("c"),
        div(pos % size, w).cast("int").alias("i"),
        (pos % w).cast("int").alias("j"),
        F.get(v, pos).cast("double").alias("mean"),
        F.get(v, pos + half).cast("double").alias("logvar"),
    )
    return with_spread(cells)


def with_spread(moments: DataFrame) -> DataFrame:
    """Clamp the log variance to [-30, 20] and add variance and standard deviation; missing stays missing."""
    return moments.withColumn("logvar", clamp(present("logvar"), -30.0, 20.0)).withColumns(
        {"var": F.exp("logvar"), "std": F.exp(F.col("logvar") * 0.5)}
    )


def posterior_sample(moments: DataFrame, seed: int, keys: Sequence[str], deterministic: bool = False,
                     out: str = "sample_value") -> DataFrame:
    """A draw ``mean + std * noise``; without spread (``deterministic``) the mean itself.

    The Gaussian noise comes from two hashes of the row's key (Box-Muller), so a task that runs
    again draws the same numbers.  A missing moment gives NULL.
    """
    if deterministic:
        return moments.withColumn(out, present("mean"))
    u1, u2 = ((hash_number(seed + k, *keys) + 0.5) / float(2**52) for k in (0, 1))
    noise = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return moments.withColumn(out, present("mean") + F.exp(present("logvar") * 0.5) * noise)
