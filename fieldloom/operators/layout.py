"""Moving between packed ``fields`` and exploded ``cells``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda may be replaced by the expression behind it, which
    would then run once per array element.  Binding it to a lambda variable first rules
    that out.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def div(a, b) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def split_tensor(df: DataFrame, values: str, channels: int, h: int, w: int,
                 channel: str = "c") -> DataFrame:
    """One row per sample holding ``channels*h*w`` values -> one packed row per channel."""
    size = h * w
    keep = [c for c in df.columns if c != values]
    return df.select(
        *keep, values, F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias(channel)
    ).select(
        *keep,
        channel,
        F.lit(h).alias("h"),
        F.lit(w).alias("w"),
        F.slice(F.col(values), F.col(channel) * size + 1, F.lit(size)).cast("array<double>").alias("values"),
    )


def positions(values: Column) -> Column:
    """One row per array position.

    Later projections pick single elements by position, all in one generated loop, so
    neither the array nor its elements are copied.  (Exploding the array itself also
    makes Spark derive ``size(values) > 0`` and evaluate a derived array once more.)
    """
    n = F.size(values)
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))


def field_to_cells(fields: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Packed rows -> one row per cell.  Narrow: no shuffle."""
    pos, w = F.col("_pos"), F.col("w")
    return fields.select(*keys, "w", "values", positions(F.col("values")).alias("_pos")).select(
        *keys,
        div(pos, w).cast("int").alias("i"),
        (pos % w).cast("int").alias("j"),
        F.get(F.col("values"), pos).alias(value),
    )


def cells_to_field(cells: DataFrame, keys: Sequence[str], h: int, w: int,
                   value: str = "value") -> DataFrame:
    """Cells -> packed rows, one shuffle.  A group is one field of ``h*w`` cells.

    Cells that are missing become NULL; cells outside the shape and repeated cells are errors.
    """
    pos = F.col("i") * w + F.col("j")
    inside = F.col("i").between(0, h - 1) & F.col("j").between(0, w - 1)
    checked = cells.withColumn(
        "_pos", F.when(inside, pos).otherwise(F.raise_error(F.lit("cell outside the field")).cast("int"))
    )
    packed = checked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.col(value).alias("_v")))).alias("_s")
    )
    once = F.size(F.array_distinct(F.transform("_s", lambda x: x["_pos"]))) == F.size("_s")
    packed = packed.withColumn("_s", F.when(once, F.col("_s")).otherwise(F.raise_error(F.lit("a cell is repeated"))))
    dense = F.transform("_s", lambda x: x["_v"])
    # Sparse field: put the right number of NULLs before every present cell, then the tail.
    holes = F.flatten(
        F.transform(
            "_s",
            lambda x, k: F.concat(
                F.array_repeat(
                    F.lit(None).cast(cells.schema[value].dataType),
                    x["_pos"] - F.when(k == 0, F.lit(-1)).otherwise(F.get(F.col("_s"), k - 1)["_pos"]) - 1,
                ),
                F.array(x["_v"]),
            ),
        )
    )
    tail = F.array_repeat(
        F.lit(None).cast(cells.schema[value].dataType),
        F.lit(h * w - 1) - F.element_at("_s", -1)["_pos"],
    )
    return packed.select(
        *keys,
        F.lit(h).alias("h"),
        F.lit(w).alias("w"),
        F.when(F.size("_s") == h * w, dense).otherwise(F.concat(holes, tail)).alias("values"),
    )
