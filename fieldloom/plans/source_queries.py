"""S rows and F01 on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import human_size, size_in
from ..operators import scoring as sc
from ..operators.layout import field_to_cells
from ..sources import containers as ct
from ..sources import files as fl
from ..sources import manifests as mf
from ..sources import media as md
from ..sources import results as rs
from . import views as v
from .registry import q6, qstamp, query, r6, stamp
from .views import with_views

HOURS = "hours AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events)"


def _hours(spark, sf):
    return v.table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("ts")).distinct()


@query(
    "s01_field_manifest",
    f"""WITH {HOURS}, ch AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS channel_idx, unnest(['z', 'z', 't', 't', 'msl', 'tp']) AS variable,
 unnest([500, 850, 500, 850, NULL, NULL])::DOUBLE AS level)
SELECT {qstamp("ts")} AS ts, channel_idx, variable, level,
 concat(CASE WHEN level IS NULL THEN 'single/' ELSE '' END, strftime(ts, '%Y/%Y-%m-%d/%H:%M:%S'), '-', variable,
   CASE WHEN level IS NULL THEN '' ELSE concat('-', CAST(level AS VARCHAR)) END, '.npy') AS path FROM hours, ch""",
)
def s01(spark, sf):
    channels = mf.channel_list(["z", "t"], [500, 850], ["msl", "tp"])
    out = mf.field_manifest(_hours(spark, sf), channels)
    return out.select(stamp("ts").alias("ts"), "channel_idx", "variable", "level", "path")


@query(
    "s01_field_manifest_files",
    f"""WITH {HOURS} SELECT {qstamp("ts")} AS ts, kind, concat(strftime(ts, 'data/%Y/%Y-%m-%dT%H:%M:%S'), '_', kind, '.nc') AS path
FROM hours, (SELECT unnest(['pressure', 'single']) AS kind)""",
)
def s01_files(spark, sf):
    out = mf.field_manifest(_hours(spark, sf), [], "files", root="data/")
    return out.select(stamp("ts").alias("ts"), "kind", "path")


@query(
    "s02_request_manifest",
    """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
d AS (SELECT year, CAST(m AS INTEGER) AS month, CAST(d AS INTEGER) AS day FROM y, (SELECT unnest([1, 2, 4]) AS m), range(28, 32) r(d)
  WHERE try_strptime(concat(year, '-', m, '-', d), '%Y-%m-%d') IS NOT NULL)
SELECT d.*, hour, variable, level FROM d, (SELECT unnest([0, 12])::INTEGER AS hour), (SELECT unnest(['geopotential', 'temperature']) AS variable),
 (SELECT unnest([500, 850])::INTEGER AS level)""",
)
def s02(spark, sf):
    years = v.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return mf.request_manifest(
        years, [1, 2, 4], [28, 29, 30, 31], [0, 12], ["geopotential", "temperature"], [500, 850]
    )


@query(
    "s02_request_single_level",
    """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
SELECT year, CAST(m AS INTEGER) AS month, CAST(d AS INTEGER) AS day, hour, variable FROM y, (SELECT unnest([1, 2, 4]) AS m), range(28, 32) r(d),
 (SELECT unnest([0, 12])::INTEGER AS hour), (SELECT unnest(['msl', 'tcc']) AS variable)
WHERE try_strptime(concat(year, '-', m, '-', d), '%Y-%m-%d') IS NOT NULL""",
)
def s02_single(spark, sf):
    years = v.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return mf.request_manifest(years, [1, 2, 4], [28, 29, 30, 31], [0, 12], ["msl", "tcc"])


@query(
    "s02_request_for_times",
    f"""WITH {HOURS} SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H:%M:%S') AS "time",
 variable, level FROM hours, (SELECT unnest(['geopotential', 'temperature']) AS variable), (SELECT unnest([500, 850])::INTEGER AS level)""",
)
def s02_times(spark, sf):
    out = mf.request_for_times(_hours(spark, sf), ["geopotential", "temperature"], [500, 850])
    return out.drop("ts")


@query(
    "s03_completeness_check",
    f"""{with_views("blobs")}, local AS (SELECT concat(source, '/', d.doc_id, '.', lang) AS path,
  CAST(octet_length(encode(text)) - toxic AS BIGINT) AS local_size FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT path, size, coalesce(local_size, 0) AS local_size, coalesce(local_size, 0) = size AS complete
FROM blobs LEFT JOIN local USING (path)""",
)
def s03(spark, sf):
    expected = v.blobs(spark, sf).select("path", "size")
    docs = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")
    actual = docs.select(
        F.concat_ws("/", "source", F.concat("doc_id", F.lit("."), "lang")).alias("path"),
        (F.octet_length("text") - F.col("toxic")).cast("long").alias("size"),
    )
    return mf.completeness_check(expected, actual)


# Arrays of whole numbers as .npy bytes: prefix, header of 118 characters, little-endian data.
NPY_HEADER = "{'descr': '<i4', 'fortran_order': False, 'shape': (8, 8), }".ljust(117) + "\n"


def _npy_files(spark, sf):
    def little(x):
        digits = F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))
        return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])

    data = F.array_join(F.transform("embedding", lambda x: little(F.round(x.cast("double") * 1e6).cast("long"))), "")
    name = F.concat(
        F.lit("2020/2020-01-01/00:"), F.lpad(F.expr("cast(vec_id div 60 % 60 as string)"), 2, "0"), F.lit(":"),
        F.lpad(F.expr("cast(vec_id % 60 as string)"), 2, "0"), F.lit("-v"), F.col("label"), F.lit("-500.0.npy"),
    )
    head = F.concat(F.lit("934E554D5059010076" + "00"), F.hex(F.lit(NPY_HEADER)))
    return v.table(spark, sf, "embeddings").select(name.alias("path"), F.unhex(F.concat(head, data)).alias("content"))


@query(
    "s04_decode_npy",
    f"""SELECT {qstamp("TIMESTAMP '2020-01-01' + to_seconds(vec_id % 3600)")} AS ts, CASE WHEN label < 5 THEN label END AS channel_idx,
 CAST(pos // 8 AS INTEGER) AS i, CAST(pos % 8 AS INTEGER) AS j, CAST(round(CAST(x AS DOUBLE) * CAST(1000000 AS DOUBLE)) AS DOUBLE) AS value
FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)""",
)
def s04(spark, sf):
    """Channels from the sixth on are unknown to the dimension; their fields stay."""
    dim = v.table(spark, sf, "embeddings").select("label").distinct().where("label < 5").select(
        F.col("label").alias("channel_idx"), F.concat(F.lit("v"), "label").alias("variable"), F.lit(500.0).alias("level")
    )
    fields = fl.decode_npy(_npy_files(spark, sf), dim, (8, 8))
    cells = field_to_cells(fields, ["ts", "channel_idx"])
    return cells.select(stamp("ts").alias("ts"), "channel_idx", "i", "j", "value")


@query(
    "s05_list_files",
    f"""{with_views("blobs")}, named AS (SELECT CASE WHEN size % 7 = 0 THEN replace(path, '/', '/.') ELSE path END AS path, size FROM blobs)
SELECT path, size FROM named WHERE NOT contains(path, '/.') AND (ends_with(lower(path), '.en') OR ends_with(lower(path), '.de'))""",
)
def s05(spark, sf):
    hidden = F.when(F.col("size") % 7 == 0, F.replace("path", F.lit("/"), F.lit("/."))).otherwise(F.col("path"))
    files = v.blobs(spark, sf).select(hidden.alias("path"), "size")
    return fl.filter_listing(files, [".EN", ".De"], recursive=True, case_sensitive=False)


# Containers with two strings; every fifth loses its last three bytes.
def _u32(n: str) -> str:
    return f"unhex(printf('%08X', {n}))"


PACKED = f"""packed AS (SELECT doc_id, octet_length(encode(text)) AS n1, octet_length(encode(source)) AS n2,
  {_u32("CAST(doc_id % 7 AS INTEGER)")} || {_u32("CAST(doc_id % 300 AS INTEGER)")} || {_u32("2")}
  || {_u32("octet_length(encode(text))")} || encode(text) || {_u32("octet_length(encode(source))")} || encode(source) AS content FROM documents)"""


def _containers(spark, sf):
    docs = v.table(spark, sf, "documents").select(
        "doc_id",
        (F.col("doc_id") % 7).cast("int").alias("z_h"),
        (F.col("doc_id") % 300).cast("int").alias("z_w"),
        F.array(F.encode("text", "UTF-8"), F.encode("source", "UTF-8")).alias("strings"),
    )
    return ct.container_pack(docs)


@query(
    "s06_container_catalog",
    f"""WITH {PACKED}, parts AS (
  SELECT doc_id, 0 AS part, 16 AS "offset", n1 AS length FROM packed
  UNION ALL SELECT doc_id, 1, 20 + n1, n2 FROM packed WHERE doc_id % 5 <> 0)
SELECT doc_id, CAST(doc_id % 7 AS BIGINT) AS z_h, CAST(doc_id % 300 AS BIGINT) AS z_w, CAST(2 AS BIGINT) AS n_strings, part,
 CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
 CAST(8 * (n1 + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n2 END) AS BIGINT) AS total_bits, doc_id % 5 = 0 AS truncated
FROM parts JOIN packed USING (doc_id)""",
)
def s06(spark, sf):
    cut = F.when(F.col("doc_id") % 5 == 0, F.octet_length("content") - 3).otherwise(F.octet_length("content"))
    blobs = _containers(spark, sf).select("doc_id", F.substring("content", F.lit(1), cut).alias("content"))
    out = ct.container_catalog(blobs)
    return out.select(
        "doc_id", "z_h", "z_w", "n_strings", "total_bits", "truncated", F.posexplode("parts").alias("part", "_p")
    ).select("doc_id", "z_h", "z_w", "n_strings", "part", "_p.offset", "_p.length", "total_bits", "truncated")


@query(
    "s07_container_pack",
    f"""WITH {PACKED} SELECT doc_id, CAST(octet_length(content) AS BIGINT) AS size, sha256(content) AS digest FROM packed""",
)
def s07(spark, sf):
    return _containers(spark, sf).select(
        "doc_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest")
    )


def _averages(spark, sf):
    files = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item"))
    return sc.sweep_average(v.metric_runs(spark, sf), files)


AVERAGES = f"""{with_views("runs", "metric_runs")}, av AS (
  SELECT codec, qp, metric, sum(value) / (SELECT count(*) FROM supplier) AS value FROM metric_runs GROUP BY ALL),
pos AS (SELECT codec, metric, CAST(row_number() OVER (PARTITION BY codec, metric ORDER BY qp) - 1 AS INTEGER) AS qp, value FROM av)"""


@query(
    "s08_read_result_docs",
    f"""{AVERAGES} SELECT x.codec, true AS available, x.qp, {q6("x.value")} AS x, {q6("-10 * log10(1 - y.value)")} AS y
FROM pos x JOIN pos y ON y.codec = x.codec AND y.qp = x.qp AND x.metric = 'bpsp' AND y.metric = 'ms-ssim-rgb'""",
)
def s08(spark, sf):
    docs = rs.parse_result_docs(rs.write_result_docs(_averages(spark, sf)))
    out = rs.rd_points(docs, "ms-ssim")
    return out.select("codec", "available", "qp", r6("x").alias("x"), r6("y").alias("y"))


@query("s09_write_result_docs", f"{AVERAGES} SELECT codec, metric, qp, {q6('value')} AS value FROM pos")
def s09(spark, sf):
    docs = rs.parse_result_docs(rs.write_result_docs(_averages(spark, sf), "sweep"))
    return rs.result_runs(docs).select("codec", "metric", "qp", r6("value").alias("value"))


@query(
    "s10_content_hash_name",
    f"""{with_views("blobs")} SELECT path, concat(path, '-', substr(sha256(content), 1, 8), '.bin') AS published FROM blobs""",
)
def s10(spark, sf):
    return fl.content_hash_name(v.blobs(spark, sf), name="path", extension=".bin").select("path", "published")


@query(
    "s11_split_listing",
    """SELECT concat(CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END, '/', doc_id, '.', lang) AS path
FROM documents WHERE doc_id % 10 = 1""",
)
def s11(spark, sf):
    part = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "valid").otherwise("train")
    files = v.table(spark, sf, "documents").select(F.concat(part, F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"))
    return fl.split_listing(files, "valid")


@query(
    "s12_clip_frame_sampler",
    """WITH f AS (SELECT conv_id AS clip, turn AS frame, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
  count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
s AS (SELECT *, greatest(1, least(2, (n + 2) // 3)) AS stride FROM f)
SELECT clip, frame, CAST(stride AS BIGINT) AS stride FROM s WHERE (rn - 1) % stride = 0 AND rn <= 3 * stride""",
)
def s12(spark, sf):
    frames = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("clip"), F.col("turn").alias("frame")
    ).distinct()
    return md.clip_frame_sampler(frames, interval=2).select("clip", "frame", "stride")


@query(
    "s12_clip_frame_draw",
    """WITH f AS (SELECT conv_id AS clip, turn AS frame, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
  count(*) OVER (PARTITION BY conv_id) AS n, CAST('0x' || substr(md5(concat('3,', conv_id)), 1, 13) AS BIGINT) AS draw
  FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
s AS (SELECT *, draw % greatest(1, (n + 2) // 3) + 1 AS stride FROM f),
t AS (SELECT *, (rn - 1) // stride AS ahead, least(3, CAST(ceil(n / CAST(stride AS DOUBLE)) AS BIGINT)) AS taken FROM s
  WHERE (rn - 1) % stride = 0 AND rn <= 3 * stride)
SELECT clip, frame, CAST(stride AS BIGINT) AS stride, CAST(CASE WHEN draw % 2 = 1 THEN taken - 1 - ahead ELSE ahead END AS INTEGER) AS position FROM t""",
)
def s12_draw(spark, sf):
    frames = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("clip"), F.col("turn").alias("frame")
    ).distinct()
    return md.clip_frame_draw(frames, 3).select("clip", "frame", "stride", "position")


@query(
    "s13_tuplet_expand",
    """WITH l AS (SELECT CASE WHEN n_chars % 10 = 0 THEN '  ' ELSE concat(lang, '/', doc_id, ' ') END AS line FROM documents)
SELECT line, CAST(i AS INTEGER) AS idx, concat('sequences/', rtrim(line), '/im', i, '.png') AS path FROM l, range(1, 8) r(i) WHERE trim(line) <> ''""",
)
def s13(spark, sf):
    line = F.when(F.col("n_chars") % 10 == 0, "  ").otherwise(F.concat("lang", F.lit("/"), "doc_id", F.lit(" ")))
    return md.tuplet_expand(v.table(spark, sf, "documents").select(line.alias("line")), 7)


# File names made from document numbers: sizes, rates, depths and formats of several kinds.
RATES = ["24fps", "29.97Hz", "12.5fps", "60Hz", ""]
DEPTHS = ["8bit", "10bit", ""]
FORMATS = ["yuv420", "P422", "i420_10LE", "y42B", "yuv444p12BE", "grey"]


def _names(spark, sf):
    pick = lambda xs, by: F.get(F.array(*[F.lit(x) for x in xs]), ((F.col("doc_id") / by).cast("long") % len(xs)).cast("int"))
    name = F.concat_ws(
        "_",
        F.concat(F.lit("clip"), "doc_id"),
        F.concat((F.col("doc_id") % 90 * 16 + 17).cast("string"), F.lit("x"), (F.col("doc_id") % 50 * 8 + 9).cast("string")),
        pick(RATES, 1), pick(DEPTHS, 5), pick(FORMATS, 15),
    )
    return v.table(spark, sf, "documents").select(
        "doc_id", F.concat(name, F.lit(".yuv")).alias("name"), (F.col("n_chars") * 100000).alias("size")
    )


NAMES = f"""names AS (SELECT doc_id, concat('clip', doc_id, '_', doc_id % 90 * 16 + 17, 'x', doc_id % 50 * 8 + 9, '_',
  {RATES}[doc_id % 5 + 1], '_', {DEPTHS}[doc_id // 5 % 3 + 1], '_', {FORMATS}[doc_id // 15 % 6 + 1], '.yuv') AS name,
  n_chars * 100000 AS size FROM documents)"""
FMT = "(yuv400|yuv420|420|p420|i420|yuv422|p422|i422|y42B|yuv444|p444|y444)(?:[p_]?(\\d+)(LE|BE))?"
META = f"""{NAMES}, raw AS (SELECT *, nullif(regexp_extract(name, '(\\d+)x(\\d+)', 1), '') AS w, nullif(regexp_extract(name, '(\\d+)x(\\d+)', 2), '') AS h,
  nullif(regexp_extract(name, '([\\d.]+)(?:Hz|fps)', 1), '') AS rate, CAST(nullif(regexp_extract(name, '(\\d+)bit', 1), '') AS INTEGER) AS d1,
  nullif(regexp_extract(name, '{FMT}', 1), '') AS fmt, CAST(nullif(regexp_extract(name, '{FMT}', 2), '') AS INTEGER) AS d2,
  nullif(regexp_extract(name, '{FMT}', 3), '') AS en FROM names),
meta AS (SELECT doc_id, name, size, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height,
  CASE WHEN fmt IN ('yuv420', '420', 'p420', 'i420') THEN 'yuv420' WHEN fmt IN ('yuv422', 'p422', 'i422') THEN 'yuv422'
       WHEN fmt IN ('yuv444', 'p444', 'y444') THEN 'yuv444' ELSE fmt END AS format,
  lower(en) AS endianness, 'yuv' AS extension, CASE WHEN d1 <> d2 THEN 'bit depth given twice' END AS error,
  CASE WHEN d1 <> d2 THEN NULL ELSE coalesce(d2, d1) END AS bitdepth,
  CAST(CASE rate WHEN '29.97' THEN 30000 WHEN '12.5' THEN 25 WHEN '24' THEN 24 WHEN '60' THEN 60 END AS BIGINT) AS fps_num,
  CAST(CASE rate WHEN '29.97' THEN 1001 WHEN '12.5' THEN 2 WHEN '24' THEN 1 WHEN '60' THEN 1 END AS BIGINT) AS fps_den FROM raw)"""


@query(
    "s14_video_name_metadata",
    f"""WITH {META} SELECT doc_id, name, width, height, format, endianness, extension, error, bitdepth, fps_num, fps_den FROM meta""",
)
def s14(spark, sf):
    return md.video_name_metadata(_names(spark, sf)).drop("size")


@query(
    "s15_frame_count",
    f"""WITH {META}, g AS (SELECT *, CASE format WHEN 'yuv420' THEN round_even(width / CAST(2 AS DOUBLE), 0) * round_even(height / CAST(2 AS DOUBLE), 0)
    WHEN 'yuv422' THEN round_even(width / CAST(2 AS DOUBLE), 0) * height WHEN 'yuv444' THEN CAST(width AS DOUBLE) * height END AS chroma,
  CASE WHEN bitdepth = 8 THEN 1 WHEN bitdepth IN (10, 12, 14, 16) THEN 2 END AS item FROM meta)
SELECT doc_id, CAST(floor(size / (width * height + 2 * chroma * item)) AS BIGINT) AS frames,
 CAST(floor(size / ((width * height + 2 * chroma) * item)) AS BIGINT) AS frames_correct FROM g""",
)
def s15(spark, sf):
    return md.frame_count(md.video_name_metadata(_names(spark, sf))).select("doc_id", "frames", "frames_correct")


@query(
    "s15_plane_shapes",
    f"""WITH {META}, k AS (SELECT unnest(['y', 'u', 'v']) AS plane)
SELECT doc_id, plane, CAST(CASE WHEN format IS NULL OR format NOT IN ('yuv400', 'yuv420', 'yuv422', 'yuv444') THEN NULL WHEN plane = 'y' THEN height
  WHEN format = 'yuv400' THEN 0 WHEN format = 'yuv420' THEN (height + 1) // 2 ELSE height END AS INTEGER) AS "rows",
 CAST(CASE WHEN format IS NULL OR format NOT IN ('yuv400', 'yuv420', 'yuv422', 'yuv444') THEN NULL WHEN plane = 'y' THEN width
  WHEN format = 'yuv400' THEN 0 WHEN format IN ('yuv420', 'yuv422') THEN (width + 1) // 2 ELSE width END AS INTEGER) AS columns FROM meta, k""",
)
def s15_planes(spark, sf):
    return md.plane_shapes(md.video_name_metadata(_names(spark, sf))).select("doc_id", "plane", "rows", "columns")


@query(
    "f01_human_size",
    f"""WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS DOUBLE) * power(1000, doc_id % 5) AS n FROM documents),
u AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < power(1024, 2) THEN 1 WHEN n < power(1024, 3) THEN 2
  WHEN n < power(1024, 4) THEN 3 WHEN n < power(1024, 5) THEN 4 ELSE 5 END AS p FROM s),
t AS (SELECT doc_id, n, p, CAST(floor(n / power(1024, p) * 10 + 0.5) AS BIGINT) AS tenths FROM u)
SELECT doc_id, concat(CASE WHEN tenths % 10 = 0 THEN CAST(tenths // 10 AS VARCHAR) ELSE concat(tenths // 10, '.', tenths % 10) END,
 ['', 'K', 'M', 'G', 'T', 'P'][p + 1]) AS human, n / power(1024, 2) AS mb FROM t""",
)
def f01(spark, sf):
    n = F.octet_length("text").cast("double") * F.pow(F.lit(1000.0), F.col("doc_id") % 5)
    docs = v.table(spark, sf, "documents").select("doc_id", n.alias("n"))
    return docs.select("doc_id", human_size(F.col("n")).alias("human"), size_in(F.col("n"), "MB").alias("mb"))
