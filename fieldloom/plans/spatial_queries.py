"""G rows on the shared tables: 8x8 planes, and latents for the channel rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import rgb_to_ycbcr, ycbcr_to_rgb
from ..operators import spatial as sp
from ..operators.layout import field_to_cells
from . import views as v
from .registry import q6, query, r6
from .views import with_views

PLANE = with_views("plane")
KEYS = ["sample", "channel"]
CELL = ["sample", "channel", "i", "j"]


def _out(cells, *extra):
    return cells.select(*CELL, *extra, r6("value").alias("value"))


@query(
    "g01_crop",
    f"""{PLANE}, o AS (SELECT *, CAST(sample % 3 AS INTEGER) AS y, CAST(sample % 4 AS INTEGER) AS x FROM plane)
SELECT sample, channel, i - y AS i, j - x AS j, {q6("value")} AS value FROM o
WHERE i >= y AND i < y + 5 AND j >= x AND j < x + 4""",
)
def g01(spark, sf):
    y, x = (F.col("sample") % 3).cast("int"), (F.col("sample") % 4).cast("int")
    return _out(sp.crop(v.plane(spark, sf), y, x, 5, 4))


PADDED = """k AS (SELECT DISTINCT sample, channel FROM plane),
frame AS (SELECT sample, channel, CAST(p // 12 AS INTEGER) AS i, CAST(p % 12 AS INTEGER) AS j FROM k, range(0, 144) r(p)),
padded AS (SELECT f.sample, f.channel, f.i, f.j, coalesce(value, 0) AS value FROM frame f
  LEFT JOIN plane p ON p.sample = f.sample AND p.channel = f.channel AND p.i = f.i - 2 AND p.j = f.j - 2)"""


@query("g02_pad_center", f"{PLANE}, {PADDED} SELECT sample, channel, i, j, {q6('value')} AS value FROM padded")
def g02(spark, sf):
    return _out(field_to_cells(sp.pad_center(v.plane_fields(spark, sf), 8, 8, 6), KEYS))


@query(
    "g02_pad_to_size",
    f"""{PLANE}, k AS (SELECT DISTINCT sample, channel FROM plane),
frame AS (SELECT sample, channel, CAST(p // 15 AS INTEGER) AS i, CAST(p % 15 AS INTEGER) AS j FROM k, range(0, 135) r(p))
SELECT f.sample, f.channel, f.i, f.j, {q6("coalesce(value, 0)")} AS value FROM frame f
LEFT JOIN plane p ON p.sample = f.sample AND p.channel = f.channel AND p.i = f.i AND p.j = f.j - 3""",
)
def g02_size(spark, sf):
    return _out(field_to_cells(sp.pad_center(v.plane_fields(spark, sf), 8, 8, out_h=9, out_w=15), KEYS))


@query("g03_unpad", f"{PLANE} SELECT sample, channel, i, j, {q6('value')} AS value FROM plane")
def g03(spark, sf):
    padded = field_to_cells(sp.pad_center(v.plane_fields(spark, sf), 8, 8, 6), KEYS)
    return _out(sp.unpad(padded, 8, 8, 6))


@query(
    "g04_tile",
    f"""{PLANE}, k AS (SELECT DISTINCT sample, channel FROM plane),
frame AS (SELECT sample, channel, p // 10 AS i, p % 10 AS j FROM k, range(0, 90) r(p))
SELECT f.sample, f.channel, CAST((f.i // 3) * 2 + f.j // 5 AS INTEGER) AS tile, CAST(f.i % 3 AS INTEGER) AS i,
 CAST(f.j % 5 AS INTEGER) AS j, {q6("coalesce(value, 0)")} AS value
FROM frame f LEFT JOIN plane p ON p.sample = f.sample AND p.channel = f.channel AND p.i = f.i AND p.j = f.j""",
)
def g04(spark, sf):
    return _out(sp.tile(v.plane_fields(spark, sf), KEYS, 8, 8, 3, 5), "tile")


@query("g04_untile", f"{PLANE} SELECT sample, channel, i, j, {q6('value')} AS value FROM plane")
def g04_inverse(spark, sf):
    return _out(sp.untile(sp.tile(v.plane_fields(spark, sf), KEYS, 8, 8, 3, 5), 8, 8, 3, 5))


@query(
    "g05_downsample_avg",
    f"""{PLANE} SELECT sample, channel, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, {q6("avg(value)")} AS value
FROM plane GROUP BY ALL""",
)
def g05(spark, sf):
    return _out(field_to_cells(sp.downsample_avg(v.plane_fields(spark, sf), 8, 8), KEYS))


@query(
    "g06_regrid_nearest",
    f"""{PLANE}, t AS (SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, a * 8 // 5 AS si, b * 8 // 11 AS sj FROM range(0, 5) x(a), range(0, 11) y(b))
SELECT sample, channel, t.i, t.j, {q6("value")} AS value FROM t JOIN plane p ON p.i = si AND p.j = sj""",
)
def g06(spark, sf):
    return _out(sp.regrid_nearest(v.plane(spark, sf), 8, 8, 5, 11))


@query(
    "g07_regrid_bilinear",
    f"""{PLANE},
ti AS (SELECT t, greatest((t + 0.5) * CAST(8 AS DOUBLE) / 5 - 0.5, 0) AS p FROM range(0, 5) r(t)),
tj AS (SELECT t, greatest((t + 0.5) * CAST(8 AS DOUBLE) / 13 - 0.5, 0) AS p FROM range(0, 13) r(t)),
wi AS (SELECT t, least(floor(p), 7) AS s, 1 - (p - floor(p)) AS w FROM ti UNION ALL SELECT t, least(floor(p) + 1, 7), p - floor(p) FROM ti),
wj AS (SELECT t, least(floor(p), 7) AS s, 1 - (p - floor(p)) AS w FROM tj UNION ALL SELECT t, least(floor(p) + 1, 7), p - floor(p) FROM tj)
SELECT sample, channel, CAST(wi.t AS INTEGER) AS i, CAST(wj.t AS INTEGER) AS j, {q6("sum(value * wi.w * wj.w)")} AS value
FROM plane JOIN wi ON wi.s = plane.i JOIN wj ON wj.s = plane.j GROUP BY ALL""",
)
def g07(spark, sf):
    return _out(field_to_cells(sp.regrid_bilinear(v.plane_fields(spark, sf), 8, 8, 5, 13), KEYS))


@query(
    "g08_gaussian_blur",
    f"""{PLANE}, raw AS (SELECT d, exp(-0.5 * power(d / CAST(1.5 AS DOUBLE), 2)) AS e FROM range(-2, 3) r(d)),
k AS (SELECT d, e / (SELECT sum(e) FROM raw) AS w FROM raw),
t AS (SELECT o, least(greatest(o + d, 0), 7) AS s, sum(w) AS w FROM range(0, 8) x(o), k GROUP BY ALL)
SELECT sample, channel, CAST(a.o AS INTEGER) AS i, CAST(b.o AS INTEGER) AS j, {q6("sum(value * a.w * b.w)")} AS value
FROM plane JOIN t a ON a.s = plane.i JOIN t b ON b.s = plane.j GROUP BY ALL""",
)
def g08(spark, sf):
    return _out(field_to_cells(sp.gaussian_blur(v.plane_fields(spark, sf), 8, 8, 5, 1.5), KEYS))


@query(
    "g09_space_to_depth",
    f"""{with_views("latent")} SELECT sample, CAST(((i % 2) * 2 + j % 2) * 4 + c AS INTEGER) AS c, CAST(i // 2 AS INTEGER) AS i,
 CAST(j // 2 AS INTEGER) AS j, {q6("y")} AS y FROM latent""",
)
def g09(spark, sf):
    return sp.space_to_depth(v.latent(spark, sf), 4, 2).select("sample", "c", "i", "j", r6("y").alias("y"))


@query("g09_depth_to_space", f"{with_views('latent')} SELECT sample, c, i, j, {q6('y')} AS y FROM latent")
def g09_inverse(spark, sf):
    back = sp.depth_to_space(sp.space_to_depth(v.latent(spark, sf), 4, 2), 4, 2)
    return back.select("sample", "c", "i", "j", r6("y").alias("y"))


# Every value is red once: green and blue are those one and two planes on, around the vector's end.
RGB = f"""{with_views("latent")}, rgb AS (SELECT r.sample, r.c, r.i, r.j, r.y AS r, g.y AS g, b.y AS b FROM latent r
  JOIN latent g ON g.sample = r.sample AND g.i = r.i AND g.j = r.j AND g.c = (r.c + 1) % 4
  JOIN latent b ON b.sample = r.sample AND b.i = r.i AND b.j = r.j AND b.c = (r.c + 2) % 4)"""


def _rgb(spark, sf):
    tensors = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("x")
    )
    turned = lambda k: F.concat(F.slice("x", 16 * k + 1, 64), F.slice("x", 1, 16 * k)) if k else F.col("x")
    planes = F.arrays_zip(*[turned(k).alias(n) for k, n in enumerate("rgb")])
    return tensors.select("sample", F.posexplode(planes).alias("_p", "_z")).select(
        "sample", F.expr("CAST(_p DIV 16 AS INT)").alias("c"), F.expr("CAST(_p % 16 DIV 4 AS INT)").alias("i"),
        F.expr("CAST(_p % 4 AS INT)").alias("j"), *[F.col("_z")[n].alias(n) for n in "rgb"],
    )


@query(
    "g10_rgb_to_ycbcr",
    f"""{RGB}, y AS (SELECT *, CAST(0.2126 AS DOUBLE) * r + CAST(0.7152 AS DOUBLE) * g + CAST(0.0722 AS DOUBLE) * b AS y FROM rgb)
SELECT sample, c, i, j, {q6("y")} AS y, {q6("0.5 * (b - y) / (1 - 0.0722) + 0.5")} AS cb, {q6("0.5 * (r - y) / (1 - 0.2126) + 0.5")} AS cr FROM y""",
)
def g10(spark, sf):
    return rgb_to_ycbcr(_rgb(spark, sf)).select("sample", "c", "i", "j", *[r6(x).alias(x) for x in ("y", "cb", "cr")])


@query("g10_ycbcr_to_rgb", f"{RGB} SELECT sample, c, i, j, {q6('r')} AS r, {q6('g')} AS g, {q6('b')} AS b FROM rgb")
def g10_inverse(spark, sf):
    ycc = rgb_to_ycbcr(_rgb(spark, sf)).select("sample", "c", "i", "j", "y", "cb", "cr")
    return ycbcr_to_rgb(ycc).select("sample", "c", "i", "j", *[r6(x).alias(x) for x in "rgb"])
