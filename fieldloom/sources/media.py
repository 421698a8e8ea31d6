"""Clip samples, tuplet lists and raw video names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numeric import hash_number
from ..operators.layout import div

# Pixel format names and the layout each stands for, in matching order.
VIDEO_FORMATS = {
    "yuv400": "yuv400",
    "yuv420": "yuv420",
    "420": "yuv420",
    "p420": "yuv420",
    "i420": "yuv420",
    "yuv422": "yuv422",
    "p422": "yuv422",
    "i422": "yuv422",
    "y42B": "yuv422",
    "yuv444": "yuv444",
    "p444": "yuv444",
    "y444": "yuv444",
}

# Chroma subsampling (across, down) per layout; 4:0:0 has no chroma.
SUBSAMPLING = {"yuv420": (2, 2), "yuv422": (2, 1), "yuv444": (1, 1)}

# Broadcast frame rates that stand for exact fractions.
FRACTIONS = {
    "23.98": (24000, 1001),
    "23.976": (24000, 1001),
    "29.97": (30000, 1001),
    "59.94": (60000, 1001),
}


def clip_frame_sampler(frames: DataFrame, interval: int = 1, max_frames: int = 3, clip: str = "clip",
                       frame: str = "frame") -> DataFrame:
    """S12, fixed stride: from each clip's sorted frames take the first ``max_frames`` at a stride.

    The stride is ``interval``, but at most ``(n + 2) // max_frames`` for a clip of ``n`` frames.
    Only the leading ``max_frames * interval`` frames of a clip can matter, and that literal
    bound lets Spark cut every clip down before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(clip).orderBy(frame))
    lead = frames.withColumn("_rn", rank).where(F.col("_rn") <= max_frames * interval)
    counts = frames.groupBy(clip).agg(F.count(F.lit(1)).alias("_n"))
    stride = F.greatest(F.least(F.lit(interval).cast("long"), _widest(max_frames)), F.lit(1).cast("long"))
    return _strided(lead.join(counts, clip).withColumn("stride", stride), max_frames).drop("_rn", "_n")


def clip_frame_draw(frames: DataFrame, seed: int, max_frames: int = 3, clip: str = "clip",
                    frame: str = "frame") -> DataFrame:
    """S12, random stride and direction: both are drawn by a hash of the seed and the clip.

    The stride is drawn from 1 to ``(n + 2) // max_frames``, whatever that is; ``position`` is the
    place in the sample, from the last frame back for half of the clips.
    """
    widest = F.greatest(_widest(max_frames), F.lit(1).cast("long"))
    draw = hash_number(seed, clip)
    rank = F.row_number().over(W.partitionBy(clip).orderBy(frame))
    rows = frames.withColumns({"_rn": rank, "_n": F.count(F.lit(1)).over(W.partitionBy(clip))})
    rows = rows.withColumns({"stride": draw % widest + 1, "reverse": draw % 2 == 1})
    taken = F.least(F.lit(max_frames), F.ceil(F.col("_n") / F.col("stride")))
    ahead = div(F.col("_rn") - 1, F.col("stride"))
    place = F.when(F.col("reverse"), taken - 1 - ahead).otherwise(ahead).cast("int")
    return _strided(rows, max_frames).withColumn("position", place).drop("_rn", "_n")


def _widest(max_frames: int) -> Column:
    return F.expr(f"(_n + 2) DIV {max_frames}")


def _strided(rows: DataFrame, max_frames: int) -> DataFrame:
    at, stride = F.col("_rn"), F.col("stride")
    return rows.where(((at - 1) % stride == 0) & (at <= max_frames * stride))


def tuplet_expand(lines: DataFrame, tuplet: int, line: str = "line", root: str = "") -> DataFrame:
    """Every non-blank line -> the paths of its images, ``im1`` to ``imN``."""
    if tuplet not in (3, 7):
        raise ValueError("tuplet must be 3 or 7")
    base = F.regexp_replace(F.col(line), r"\s+$", "")
    return (
        lines.where(F.trim(F.regexp_replace(F.col(line), r"\s", " ")) != "")
        .withColumn("idx", F.explode(F.sequence(F.lit(1), F.lit(tuplet))))
        .withColumn("path", F.concat(F.lit(root), F.lit("sequences/"), base, F.lit("/im"), F.col("idx"), F.lit(".png")))
    )


def _found(name: Column, pattern: str, group: int) -> Column:
    """The group of the first match, NULL without one."""
    hit = F.regexp_extract(name, pattern, group)
    return F.when(hit != "", hit)


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; 60 Euclid steps cover every 64-bit pair used here."""
    start = F.struct(a.alias("a"), b.alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        start,
        lambda s, _: F.struct(
            F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
            F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.when(s["b"] != 0, s["b"]).otherwise(F.lit(1).cast("long"))).alias("b"),
        ),
    )
    return done["a"]


def video_name_metadata(files: DataFrame, name: str = "name") -> DataFrame:
    """Size, frame rate, bit depth, format and byte order read off a file name.

    Each pattern is searched once over the whole name.  Whatever a name does not say is
    NULL.  Two different bit depths are reported in ``error``.  The frame rate is an
    exact reduced fraction.
    """
    n = F.col(name)
    formats = "|".join(VIDEO_FORMATS)
    # The patterns of the naming convention, here and below.
    fmt = rf"({formats})(?:[p_]?(\d+)(LE|BE))?"
    lower = F.create_map(*[F.lit(x) for k, v in VIDEO_FORMATS.items() if k == k.lower() for x in (k, v)])
    raw_format = _found(n, fmt, 1)
    rate = _found(n, r"([\d.]+)(?:Hz|fps)", 1)
    depth = _found(n, r"(\d+)bit", 1).cast("int")
    depth2 = _found(n, fmt, 2).cast("int")

    plain = rate.rlike(r"^(\d+\.?\d*|\.\d+)$")
    decimals = F.length(F.regexp_extract(rate, r"\.(\d+)$", 1))
    top = F.when(plain, F.regexp_replace(rate, r"\.", "")).cast("long")
    bottom = F.when(plain, F.pow(F.lit(10), decimals)).cast("long")
    known_num = F.create_map(*[F.lit(x) for k, (a, _) in FRACTIONS.items() for x in (k, a)])
    known_den = F.create_map(*[F.lit(x) for k, (_, b) in FRACTIONS.items() for x in (k, b)])

    out = files.withColumns(
        {
            "width": _found(n, r"(\d+)x(\d+)", 1).cast("int"),
            "height": _found(n, r"(\d+)x(\d+)", 2).cast("int"),
            "format": F.coalesce(F.try_element_at(lower, F.lower(raw_format)), raw_format),
            "endianness": F.lower(_found(n, fmt, 3)),
            "extension": _found(n, r"(yuv|rgb|raw)", 1),
            "error": F.when(depth != depth2, F.lit("bit depth given twice")),
            "_rate": rate, "_top": top, "_bottom": bottom, "_d": depth, "_d2": depth2,
        }
    ).withColumn("_g", _gcd(F.col("_top"), F.col("_bottom")))
    return out.withColumns(
        {
            "bitdepth": F.when(F.col("error").isNull(), F.coalesce("_d2", "_d")),
            "fps_num": F.coalesce(
                F.try_element_at(known_num, F.col("_rate")).cast("long"), F.expr("_top DIV NULLIF(_g, 0)")
            ),
            "fps_den": F.coalesce(
                F.try_element_at(known_den, F.col("_rate")).cast("long"), F.expr("_bottom DIV NULLIF(_g, 0)")
            ),
        }
    ).drop("_rate", "_top", "_bottom", "_d", "_d2", "_g")


def frame_count(meta: DataFrame, size: str = "size") -> DataFrame:
    """Whole frames in a raw video file.

    ``frames`` counts the sample width for chroma only, as existing catalogues do;
    ``frames_correct`` counts it for luma too.  They agree for 8-bit video.
    """
    luma = F.col("width").cast("double") * F.col("height")
    across = F.create_map(*[F.lit(x) for k, (a, _) in SUBSAMPLING.items() for x in (k, a)])
    down = F.create_map(*[F.lit(x) for k, (_, b) in SUBSAMPLING.items() for x in (k, b)])
    cw = F.rint(F.col("width") / F.try_element_at(across, F.col("format")))
    ch = F.rint(F.col("height") / F.try_element_at(down, F.col("format")))
    item = F.when(F.col("bitdepth") == 8, 1).when(F.col("bitdepth").isin(10, 12, 14, 16), 2)
    frame = luma + 2 * cw * ch * item
    correct = (luma + 2 * cw * ch) * item
    whole = lambda f: F.when(f > 0, F.floor(F.col(size) / f).cast("long"))
    return meta.withColumns({"frames": whole(frame), "frames_correct": whole(correct)})


def plane_shapes(meta: DataFrame) -> DataFrame:
    """The planes of one frame, a row each: ``plane`` (y, u, v), ``rows`` and ``columns``.

    Half a chroma side of odd length is rounded up, unlike in the frame count, which rounds half
    to even.  4:0:0 has chroma planes without samples; an unknown format has NULL shapes.
    """
    across = F.create_map(*[F.lit(x) for k, (a, _) in SUBSAMPLING.items() for x in (k, a)])
    down = F.create_map(*[F.lit(x) for k, (_, b) in SUBSAMPLING.items() for x in (k, b)])
    known = F.col("format").isin(sorted(set(VIDEO_FORMATS.values())))

    def side(size: str, by: Column) -> Column:
        step = F.try_element_at(by, F.col("format"))
        part = F.when(F.col("format") == "yuv400", 0).otherwise(div(F.col(size) + step - 1, step))
        return F.when(known, part).cast("int")

    shape = lambda plane, rows, columns: F.struct(F.lit(plane).alias("plane"), rows.alias("rows"), columns.alias("columns"))
    luma = [F.when(known, F.col(c)).cast("int") for c in ("height", "width")]
    chroma = [side("height", down), side("width", across)]
    planes = F.array(shape("y", *luma), shape("u", *chroma), shape("v", *chroma))
    return meta.withColumn("_p", F.explode(planes)).withColumns(
        {c: F.col("_p")[c] for c in ("plane", "rows", "columns")}
    ).drop("_p")
