import datetime as dt
import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import channels as ch
from fieldloom.sources import containers as ct
from fieldloom.sources import fieldstore as fs
from fieldloom.sources import files as fl
from fieldloom.sources import manifests as mf
from fieldloom.sources import media as md
from fieldloom.sources import npy
from fieldloom.sources import results as rs

T0 = dt.datetime(2024, 3, 5, 6)


def pack(z_h, z_w, strings):
    out = struct.pack(">3I", z_h, z_w, len(strings))
    return out + b"".join(struct.pack(">I", len(s)) + s for s in strings)


def catalog(spark, *blobs):
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blobs)], "k int, content binary")
    return ct.container_catalog(df).orderBy("k").collect()


def test_container_catalog(spark):
    big = pack(1, 2, [b"abc", b"x" * 70000])
    none, one, two = catalog(spark, pack(4, 5, []), pack(9, 300, [b"hello"]), big)
    assert (none.z_h, none.z_w, none.n_strings, none.parts, none.total_bits, none.truncated) == (4, 5, 0, [], 0, False)
    assert ([tuple(p) for p in one.parts], one.total_bits, one.truncated) == ([(16, 5)], 40, False)
    assert ([tuple(p) for p in two.parts], two.truncated) == ([(16, 3), (23, 70000)], False)


def test_truncated_containers(spark):
    whole = pack(1, 2, [b"abc", b"defgh"])
    cut, mid, header, empty, lying = catalog(
        spark, whole[:-1], whole[:20], whole[:7], b"", struct.pack(">3I", 1, 1, 4_000_000_000)
    )
    assert ([tuple(p) for p in cut.parts], cut.truncated) == ([(16, 3)], True)
    assert ([tuple(p) for p in mid.parts], mid.truncated) == ([(16, 3)], True)
    assert (header.z_h, header.truncated, header.total_bits) == (None, True, 0)
    assert (empty.z_h, empty.truncated) == (None, True)
    assert (lying.n_strings, lying.parts, lying.truncated) == (4_000_000_000, [], True)


def test_pack_is_the_inverse(spark):
    strings = [b"", b"\x00\xff", b"abc"]
    df = spark.createDataFrame([(7, 4_000_000_000, [bytearray(s) for s in strings])], "z_h long, z_w long, strings array<binary>")
    packed = ct.container_pack(df)
    assert bytes(packed.first().content) == pack(7, 4_000_000_000, strings)
    r = ct.container_catalog(packed).first()
    assert (r.z_h, r.z_w, [p.length for p in r.parts], r.truncated) == (7, 4_000_000_000, [0, 2, 3], False)


def test_scan_npy(spark, tmp_path):
    rng = np.random.default_rng(0)
    channels = mf.channel_list(["z"], [500, 850], ["msl"])
    times = spark.createDataFrame([(T0,), (T0 + dt.timedelta(hours=1),)], "ts timestamp_ntz")
    manifest = mf.field_manifest(times, channels, clock_format="HH-mm-ss").collect()
    want = {}
    for r in manifest:
        a = rng.normal(size=(3, 4)).astype(np.float32)
        (tmp_path / r.path).parent.mkdir(parents=True, exist_ok=True)
        np.save(tmp_path / r.path, a)
        want[r.ts, r.channel_idx] = a.astype(float).ravel().tolist()
    dim = ch.channel_dim(ch.channel_config(spark, ["z"], [500, 850], ["msl"]))
    got = fl.scan_npy_fields(spark, str(tmp_path), dim, (3, 4)).collect()
    assert {(r.ts, r.channel_idx): list(r["values"]) for r in got} == want
    with pytest.raises(Exception, match="shape"):
        fl.scan_npy_fields(spark, str(tmp_path), dim, (4, 3)).collect()


def test_relative_paths_take_the_root_off_once(spark):
    rows = [("file:/data/x/data/f.bin",), ("file:///data/y.bin",), ("hdfs://host:1/data/z",), ("/other/f",)]
    df = spark.createDataFrame(rows, "path string")
    for root in ("/data", "file:/data/", "hdfs://host:1/data"):
        got = [r[0] for r in df.select(fl.relative_path(F.col("path"), root)).collect()]
        assert got == ["x/data/f.bin", "y.bin", "z", "/other/f"]


def test_requests_without_levels(spark):
    years = spark.createDataFrame([(2020,)], "year int")
    assert mf.request_manifest(years, [2], [29, 30], [0], ["msl"]).columns == ["year", "month", "day", "hour", "variable"]
    with pytest.raises(ValueError):
        mf.request_manifest(years, [2], [29], [0], ["t"], [])


def test_list_files(spark, tmp_path):
    for name in ("a.TXT", "b.txt", ".hidden.txt", "c.bin", "sub/d.txt", "sub/e.Bin"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"12345")
    names = lambda *a, **k: [r.path for r in fl.list_files(spark, str(tmp_path), *a, **k).collect()]
    assert names() == ["a.TXT", "b.txt", "c.bin"]
    assert names([".txt"], recursive=True) == ["b.txt", "sub/d.txt"]
    assert names([".txt", ".bin"], recursive=True, case_sensitive=False) == ["a.TXT", "b.txt", "c.bin", "sub/d.txt", "sub/e.Bin"]
    df = fl.list_files(spark, str(tmp_path), through="spark")
    assert df.first().size == 5
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_listings_have_every_name(spark, tmp_path):
    kept = ["_a.txt", "_deep/_b.txt", "plain c.txt", "x/y/z/_SUCCESS", "x/y/100%.txt", ".dot/in.txt", "a b%20/c.txt"]
    for name in [*kept, ".hidden", "x/.h.txt"]:
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(b"1" * len(name))
    (tmp_path / "empty").mkdir()
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}", f"{tmp_path}/"):
        got = [(r.path, r.size) for r in fl.list_files(spark, root, recursive=True).collect()]
        assert got == sorted((n, len(n)) for n in kept)
    assert [r.path for r in fl.list_files(spark, str(tmp_path), [".txt"]).collect()] == ["_a.txt", "plain c.txt"]
    assert fl.list_files(spark, str(tmp_path / "empty"), recursive=True).count() == 0
    with pytest.raises(ValueError):
        fl.list_files(spark, str(tmp_path), through="other")


def _npy(a, version=None):
    out = io.BytesIO()
    np.lib.format.write_array(out, a, version=version, allow_pickle=False)
    return out.getvalue()


NPY_SHAPE = (5, 3)


@pytest.mark.parametrize("version", [(1, 0), (2, 0), (3, 0)])
def test_npy_values_of_all_types(spark, version):
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 100, NPY_SHAPE)
    arrays = {d: whole.astype(d) for d in ("<f2", "<f4", ">f4", "<f8", ">f8", "|i1", "|u1", "<i2", ">i4", "<u4", "<i8", "|b1")}
    arrays["by column"] = np.asfortranarray(rng.normal(size=NPY_SHAPE))
    arrays["with gaps"] = np.where(whole > 50, np.nan, whole)
    files = spark.createDataFrame([(k, _npy(a, version)) for k, a in arrays.items()], "path string, content binary")
    got = {r.path: r["values"] for r in npy.npy_values(files, NPY_SHAPE).collect()}
    assert set(got) == set(arrays)
    for k, a in arrays.items():
        np.testing.assert_array_equal(np.array(got[k]), a.astype(float).ravel())


@pytest.mark.parametrize("content, reason", [
    (b"", "no .npy header"), (b"\x93NUMPY\x09\x00" + bytes(20), "no .npy header"), (b"\x93NUMPY\x01\x00\xff\xff{", "no .npy header"),
    (_npy(np.zeros((3, 5))), r"shape \(3, 5\), expected \(5, 3\)"), (_npy(np.zeros(15)), r"shape \(15\)"),
    (_npy(np.zeros(NPY_SHAPE, complex)), "cells of type <c16"), (_npy(np.zeros(NPY_SHAPE))[:-1], "do not fill"), (_npy(np.zeros(NPY_SHAPE)) + b"0", "do not fill"),
])
def test_wrong_npy_files_are_named(spark, content, reason):
    files = spark.createDataFrame([("some/file.npy", content)], "path string, content binary")
    with pytest.raises(Exception, match="some/file.npy: .*" + reason):
        npy.npy_values(files, NPY_SHAPE).collect()
    assert npy.npy_values(files, NPY_SHAPE).select("path").count() == 1


def test_npy_headers(spark):
    rows = [("a", _npy(np.zeros((2, 7), "<f4"))), ("b", b"text"), ("c", None)]
    got = {r.path: r for r in npy.npy_header(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["a"].descr, got["a"].fortran, got["a"].shape) == ("<f4", False, [2, 7])
    assert all(got[k][c] is None for k in "bc" for c in ("descr", "fortran", "shape", "body_at"))


def test_request_manifest_drops_impossible_dates(spark):
    years = spark.createDataFrame([(2023,), (2024,)], "year int")
    rows = mf.request_manifest(years, [2, 4], [28, 29, 30, 31], [0], ["t"], [500]).collect()
    got = {(r.year, r.month, r.day) for r in rows}
    assert got == {(2023, 2, 28), (2024, 2, 28), (2024, 2, 29)} | {(y, 4, d) for y in (2023, 2024) for d in (28, 29, 30)}


def test_completeness(spark):
    want = spark.createDataFrame([("a", 3), ("b", 3), ("c", 0)], "path string, size long")
    have = spark.createDataFrame([("a", 3), ("b", 2)], "path string, size long")
    got = {r.path: (r.local_size, r.complete) for r in mf.completeness_check(want, have).collect()}
    assert got == {"a": (3, True), "b": (2, False), "c": (0, True)}


def test_result_documents(spark, tmp_path):
    wrapped = {"name": "one", "description": "d", "results": {"bpsp": [0.1, 0.2, 0.3], "mse": [5.0, 4.0]}}
    flat = {"bpsp": [0.4], "psnr-rgb": [30.0], "ms-ssim-rgb": [0.99]}
    (tmp_path / "x.json").write_text(json.dumps(wrapped, indent=1))
    (tmp_path / "two.json").write_text(json.dumps(flat))
    docs = rs.read_result_docs(spark, str(tmp_path))
    points = {(r.codec, r.qp): (r.x, r.y, r.available) for r in rs.rd_points(docs, "mse").collect()}
    assert points == {("one", 0): (0.1, 5.0, True), ("one", 1): (0.2, 4.0, True), ("one", 2): (0.3, None, True), ("two", None): (None, None, False)}
    (r,) = rs.rd_points(docs, "psnr").where("available").collect()
    assert (r.codec, r.x, r.y) == ("two", 0.4, 30.0)
    (r,) = rs.rd_points(docs, "ms-ssim").where("available").collect()
    assert r.y == pytest.approx(20.0)


def test_written_documents_read_back(spark):
    rows = [("c", q, m, float(q) + k) for q in (3, 1, 2) for k, m in enumerate(("psnr", "bpsp"))]
    docs = rs.write_result_docs(spark.createDataFrame(rows, "codec string, qp int, metric string, value double"), "why")
    assert json.loads(docs.first().text) == {
        "name": "c", "description": "why", "results": {"bpsp": [2.0, 3.0, 4.0], "psnr": [1.0, 2.0, 3.0]}
    }


def test_content_hash(spark):
    df = spark.createDataFrame([("m", bytearray(b"abc"))], "name string, content binary")
    assert fl.content_hash_name(df).first().published == "m-ba7816bf"


def test_split_listing(spark):
    df = spark.createDataFrame([("train/b",), ("train/a",), ("test/a",), ("train/x/a",)], "path string")
    assert [r.path for r in fl.split_listing(df, "train").collect()] == ["train/a", "train/b"]


def test_clip_frames(spark):
    rows = [("long", f"{k:03d}") for k in range(50)] + [("short", f"{k:03d}") for k in range(4)] + [("one", "000")]
    df = spark.createDataFrame(rows, "clip string, frame string")
    got = {}
    for r in md.clip_frame_sampler(df, interval=5).orderBy("frame").collect():
        got.setdefault(r.clip, []).append(int(r.frame))
    # Stride 5 for 50 frames, (4 + 2) // 3 = 2 for four, 1 for one.
    assert got == {"long": [0, 5, 10], "short": [0, 2], "one": [0]}
    wide = spark.createDataFrame([(f"c{c}", f) for c in range(60) for f in range(30)], "clip string, frame int")
    drawn = {}
    for r in md.clip_frame_draw(wide, 3).orderBy("position").collect():
        drawn.setdefault((r.clip, r.stride, r.reverse), []).append(r.frame)
    assert len(drawn) == 60 and {s for _, s, _ in drawn} == set(range(1, 11)) and {r for _, _, r in drawn} == {True, False}
    for (_, stride, reverse), frames in drawn.items():
        assert frames == [0, stride, 2 * stride][:: -1 if reverse else 1]


def test_tuplets(spark):
    df = spark.createDataFrame([("00001/0266 \n",), ("   ",), ("",)], "line string")
    assert [r.path for r in md.tuplet_expand(df, 3, root="r/").collect()] == [f"r/sequences/00001/0266/im{k}.png" for k in (1, 2, 3)]
    with pytest.raises(ValueError):
        md.tuplet_expand(df, 4)


VIDEOS = {
    # name: width, height, fps, depth, format, byte order, error
    "Beauty_1920x1080_120fps_420_8bit_YUV.yuv": (1920, 1080, (120, 1), 8, "yuv420", None, None),
    "x_832x480_29.97Hz_10bit_P422.yuv": (832, 480, (30000, 1001), 10, "yuv422", None, None),
    "x_64x48_23.976fps_i420_10LE.raw": (64, 48, (24000, 1001), 10, "yuv420", "le", None),
    "x_64x48_12.50fps_10bit_yuv444p12BE.yuv": (64, 48, (25, 2), None, "yuv444", "be", "bit depth given twice"),
    "x_64x48_y42B.rgb": (64, 48, None, None, "y42B", None, None),
    "plain.mp4": (None, None, None, None, None, None, None),
}


def test_video_names(spark):
    df = spark.createDataFrame([(n,) for n in VIDEOS], "name string")
    for r in md.video_name_metadata(df).collect():
        fps = None if r.fps_num is None else (r.fps_num, r.fps_den)
        want = list(VIDEOS[r.name])
        if "_P422" in r.name:
            want[4] = "yuv422" if r.format == "yuv422" else r.format  # upper case is not among the names
        assert [r.width, r.height, fps, r.bitdepth, r.format, r.endianness, r.error] == want, r.name


def test_frame_count(spark):
    rows = [(4, 2, "yuv420", 8, 240), (4, 2, "yuv420", 10, 240), (3, 5, "yuv422", 8, 1000), (4, 2, "yuv400", 8, 240), (4, 2, None, None, 240)]
    df = spark.createDataFrame(rows, "width int, height int, format string, bitdepth int, size long")
    got = [(r.frames, r.frames_correct) for r in md.frame_count(df).collect()]
    # 4x2 with 2x1 chroma: 8 + 2*2 bytes; ten bits: 8 + 2*2*2, correctly twice the 8-bit size.
    assert got[0] == (20, 20) and got[1] == (15, 10)
    # 3x5 4:2:2: round(1.5) = 2 across, 5 down.
    assert got[2] == (1000 // 35, 1000 // 35)
    assert got[3] == (None, None) and got[4] == (None, None)


def test_field_store_prunes(spark, tmp_path):
    rows = [(dt.datetime(y, 6, 1), c, 1, 2, [float(y), float(c)]) for y in (2019, 2020, 2021) for c in (0, 1)]
    fields = spark.createDataFrame(rows, "ts timestamp_ntz, channel_idx int, h int, w int, values array<double>")
    path = str(tmp_path / "store")
    fs.write_fields(fields, path)
    df = fs.read_fields(spark, path, "2020-01-01", "2020-12-31", [1])
    assert [(r.year, r.channel_idx, list(r["values"])) for r in df.collect()] == [(2020, 1, [2020.0, 1.0])]
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):]
    assert "year" in scan.split("PushedFilters")[0] and "channel_idx" in scan.split("PushedFilters")[0]
    assert "ts" in scan.split("PushedFilters")[1]
    assert fs.read_fields(spark, path).count() == 6


def test_statistics_documents(spark, tmp_path):
    doc = {"mean": {"z": [1.0, 2.0], "z_overall": 1.5, "tp": 0.5}, "std": {"z": [3.0, 4.0], "z_overall": 3.5, "tp": 0.25}, "count": 9}
    (tmp_path / "stats.json").write_text(json.dumps(doc, indent=2))
    stats = fs.read_stats_docs(spark, str(tmp_path / "stats.json"))
    dim = ch.channel_dim(ch.channel_config(spark, ["z"], [850.0], ["tp"]))
    own = fs.channel_statistics(stats, dim, [1000.0, 850.0]).orderBy("channel_idx").collect()
    assert [(r.name, r.mean, r.std, r.n) for r in own] == [("z_850", 2.0, 4.0, 9), ("tp", 0.5, 0.25, 9)]
    both = fs.channel_statistics(stats, dim, [1000.0, 850.0], "overall").orderBy("channel_idx").collect()
    assert [(r.name, r.mean, r.std) for r in both] == [("z_850", 1.5, 3.5), ("tp", 0.5, 0.25)]
    with pytest.raises(ValueError):
        fs.channel_statistics(stats, dim, [850.0], "other")
