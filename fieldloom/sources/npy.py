"""The ``.npy`` container: its header as column expressions, its cells as one Arrow pass.

Fixed values of the format: six magic bytes, two version bytes, the header's size (little-endian,
two bytes in version 1, four in versions 2 and 3), a header text that names the cells' type,
their order and the shape, then the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.packed import lists

MAGIC = b"\x93NUMPY"
#: Types of cells that are read: integers, floats of two to eight bytes and flags.
CELL_TYPES = r"^[<>|=](f[248]|[iu][1248]|b1)$"


def _little(content: Column, at: int, size: int) -> Column:
    """An unsigned little-endian number of ``size`` bytes from byte ``at`` (from 0) on."""
    digits = F.concat(*[F.hex(F.substring(content, at + k, 1)) for k in range(size, 0, -1)])
    return F.conv(digits, 16, 10).cast("long")


def npy_header(files: DataFrame, content: str = "content") -> DataFrame:
    """Add what a header says: ``descr`` (the cells' type), ``fortran`` (columns first), ``shape`` and
    ``body_at``, the first byte of the cells, from 0.  Only the header is read; all four are NULL
    for a file that is not of the format.
    """
    c = F.col(content)
    wide = _little(c, 6, 1) >= 2
    ours = (F.octet_length(c) >= 12) & (F.substring(c, 1, 6) == F.lit(MAGIC)) & _little(c, 6, 1).between(1, 3)
    size = F.when(wide, _little(c, 8, 4)).otherwise(_little(c, 8, 2))
    start = F.when(wide, F.lit(12)).otherwise(F.lit(10))
    at = files.withColumns({"_start": F.when(ours, start), "_size": F.when(ours, size)})
    whole = F.col("_start") + F.col("_size") <= F.octet_length(c)
    text = F.when(whole, F.decode(F.substring(c, F.col("_start") + 1, F.col("_size").cast("int")), "ISO-8859-1"))
    found = at.withColumn("_text", text)
    shape = F.regexp_extract_all(F.regexp_extract("_text", r"'shape':\s*\(([^)]*)\)", 1), F.lit(r"(\d+)"), F.lit(1))
    return found.withColumns(
        {
            "descr": F.regexp_extract("_text", r"'descr':\s*'([^']*)'", 1),
            "fortran": F.regexp_extract("_text", r"'fortran_order':\s*(True|False)", 1) == "True",
            "shape": shape.cast("array<long>"),
            "body_at": F.when(whole, F.col("_start") + F.col("_size")),
        }
    ).drop("_start", "_size", "_text")


def npy_values(files: DataFrame, shape: tuple[int, int], out: str = "values", path: str = "path", content: str = "content") -> DataFrame:
    """Replace ``content`` by the cells in row order, as doubles; NaN stays NaN.

    A file that is not of the format, whose shape is another one, whose type of cells is not one
    of ``CELL_TYPES`` or whose cells are fewer or more than its shape says is an error that names the
    file and the reason.  Files are checked when their cells are asked for: a query without
    ``out`` reads no content.
    """
    @F.arrow_udf("array<double>")
    def decode(body: pa.Array, descr: pa.Array, fortran: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        made = []
        for cells, kind, by_column, rows, columns in zip(body, descr.to_pylist(), fortran.to_pylist(), h.to_pylist(), w.to_pylist()):
            # the cells are a view of the batch's own memory
            values = np.frombuffer(cells.as_buffer(), np.dtype(kind), rows * columns)
            made.append((values.reshape(columns, rows).T if by_column else values).astype(np.float64).ravel())
        return lists(made)

    h, w = shape
    read = npy_header(files, content)
    width = F.when(F.col("descr") == "|b1", 1).otherwise(F.right("descr", F.lit(1)).cast("int"))
    wanted = F.col("shape") == F.array(F.lit(h).cast("long"), F.lit(w).cast("long"))
    said = F.concat(F.lit("("), F.array_join(F.col("shape").cast("array<string>"), ", "), F.lit(")"))
    reason = (
        F.when(F.col("body_at").isNull(), F.lit("no .npy header"))
        .when(~wanted, F.concat(F.lit("shape "), said, F.lit(f", expected ({h}, {w})")))
        .when(~F.col("descr").rlike(CELL_TYPES), F.concat(F.lit("cells of type "), F.col("descr")))
        .when(F.octet_length(content) - F.col("body_at") != h * w * width, F.lit("its cells do not fill its shape"))
    )
    wrong = F.raise_error(F.concat(F.col(path), F.lit(": "), F.col("_wrong"))).cast("binary")
    body = F.when(F.col("_wrong").isNull(), F.substring(content, F.col("body_at").cast("int") + 1, F.octet_length(content))).otherwise(wrong)
    cells = decode(F.col("_body"), F.col("descr"), F.col("fortran"), F.lit(h), F.lit(w))
    return (
        read.withColumn("_wrong", reason).withColumn("_body", body).withColumn(out, cells)
        .drop("descr", "fortran", "shape", "body_at", "_wrong", "_body", content)
    )
