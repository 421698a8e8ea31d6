import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.color import rgb_to_ycbcr, ycbcr_to_rgb
from fieldloom.operators import spatial as sp
from fieldloom.operators.layout import cells_to_field, field_to_cells, split_tensor

H, W = 5, 7


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    return {k: rng.normal(size=(H, W)) for k in range(3)}


@pytest.fixture(scope="module")
def fields(spark, arrays):
    rows = [(k, H, W, [float(x) for x in a.ravel()]) for k, a in arrays.items()]
    return spark.createDataFrame(rows, "k int, h int, w int, values array<double>")


@pytest.fixture(scope="module")
def cells(fields):
    return field_to_cells(fields, ["k"])


def grids(df, h, w):
    """Cells or fields back to one array per key; every cell exactly once."""
    if "values" in df.columns:
        return {r.k: np.array(r["values"], dtype=float).reshape(r.h, r.w) for r in df.collect()}
    out, seen = {}, set()
    for r in df.collect():
        assert (r.k, r.i, r.j) not in seen
        seen.add((r.k, r.i, r.j))
        out.setdefault(r.k, np.full((h, w), np.nan))[r.i, r.j] = r.value
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=0, atol=1e-12)


def test_pack_and_unpack(cells, arrays):
    same(grids(cells_to_field(cells, ["k"], H, W), H, W), arrays)


def test_packing_keeps_holes(spark):
    df = spark.createDataFrame([(0, 0, 1, 5.0), (0, 1, 0, 6.0), (1, 1, 2, 7.0)], "k int, i int, j int, value double")
    got = {r.k: list(r["values"]) for r in cells_to_field(df, ["k"], 2, 3).collect()}
    assert got == {0: [None, 5.0, None, 6.0, None, None], 1: [None] * 5 + [7.0]}
    with pytest.raises(Exception, match="outside"):
        cells_to_field(df, ["k"], 1, 3).collect()


def test_split_tensor(spark):
    df = spark.createDataFrame([(9, [float(x) for x in range(12)])], "s int, v array<double>")
    got = {r.c: list(r["values"]) for r in split_tensor(df, "v", 2, 2, 3).collect()}
    assert got == {0: [0, 1, 2, 3, 4, 5], 1: [6, 7, 8, 9, 10, 11]}


def test_crop(cells, arrays):
    same(grids(sp.crop(cells, 1, 2, 3, 4), 3, 4), {k: a[1:4, 2:6] for k, a in arrays.items()})


def test_crop_origin_depends_on_the_key_only(spark):
    y, x = sp.crop_origin(10, 20, 4, 5, 7, "k")
    df = spark.range(200).withColumnRenamed("id", "k").select("k", y.alias("y"), x.alias("x"))
    rows = df.collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in df.repartition(5).collect()}
    assert {r.y for r in rows} == set(range(7)) and {r.x for r in rows} == set(range(16))
    with pytest.raises(ValueError):
        sp.crop_origin(3, 20, 4, 5, 7, "k")


@pytest.mark.parametrize("div", [1, 4, 6])
def test_pad_and_unpad(fields, arrays, div):
    h2, top, bottom = sp.padding(H, div)
    w2, left, right = sp.padding(W, div)
    padded = field_to_cells(sp.pad_center(fields, H, W, div), ["k"])
    same(grids(padded, h2, w2), {k: np.pad(a, ((top, bottom), (left, right))) for k, a in arrays.items()})
    same(grids(sp.unpad(padded, H, W, div), H, W), arrays)


def test_padding_with_a_missing_first_cell(spark):
    df = spark.createDataFrame([(1, 2, 2, [None, 2.0, 3.0, 4.0])], "k int, h int, w int, values array<double>")
    got = sp.pad_center(df, 2, 2, out_h=3, out_w=4).first()
    assert (got.h, got.w, list(got["values"])) == (3, 4, [0, None, 2, 0, 0, 3, 4, 0, 0, 0, 0, 0])
    for bad in ({}, {"min_div": 2, "out_h": 3, "out_w": 3}, {"out_h": 1, "out_w": 3}):
        with pytest.raises(ValueError):
            sp.pad_center(df, 2, 2, **bad)


def test_tile_and_untile(fields, arrays):
    tiles = sp.tile(fields, ["k"], H, W, 2, 3)
    for k, a in arrays.items():
        full = np.pad(a, ((0, 1), (0, 2)))
        for r in tiles.where(F.col("k") == k).collect():
            assert r.value == pytest.approx(full[r.tile // 3 * 2 + r.i, r.tile % 3 * 3 + r.j])
    assert tiles.count() == len(arrays) * 6 * 9
    same(grids(sp.untile(tiles, H, W, 2, 3), H, W), arrays)


def test_downsample_drops_odd_edges(fields, arrays):
    want = {k: a[:4, :6].reshape(2, 2, 3, 2).mean(axis=(1, 3)) for k, a in arrays.items()}
    same(grids(sp.downsample_avg(fields, H, W), 2, 3), want)


@pytest.mark.parametrize("h2,w2", [(5, 7), (3, 2), (11, 16), (1, 1)])
def test_nearest(cells, arrays, h2, w2):
    i, j = np.arange(h2) * H // h2, np.arange(w2) * W // w2
    same(grids(sp.regrid_nearest(cells, H, W, h2, w2), h2, w2), {k: a[np.ix_(i, j)] for k, a in arrays.items()})


@pytest.mark.parametrize("h2,w2", [(5, 7), (3, 2), (11, 16), (1, 1)])
def test_bilinear(fields, arrays, h2, w2):
    def matrix(n, m):
        out = np.zeros((m, n))
        for t in range(m):
            pos = max((t + 0.5) * n / m - 0.5, 0)
            a = min(int(pos), n - 1)
            out[t, a] += 1 - (pos - int(pos))
            out[t, min(a + 1, n - 1)] += pos - int(pos)
        return out

    want = {k: matrix(H, h2) @ a @ matrix(W, w2).T for k, a in arrays.items()}
    same(grids(sp.regrid_bilinear(fields, H, W, h2, w2), h2, w2), want)


@pytest.mark.parametrize("size", [1, 3, 9])
def test_blur(fields, arrays, size):
    kernel = np.array(sp.gaussian_kernel(size, 1.3))
    half = size // 2

    def blur(a):
        p = np.pad(a, half, mode="edge")
        p = sum(kernel[k] * p[:, k:k + W] for k in range(size))
        return sum(kernel[k] * p[k:k + H] for k in range(size))

    same(grids(sp.gaussian_blur(fields, H, W, size, 1.3), H, W), {k: blur(a) for k, a in arrays.items()})
    with pytest.raises(ValueError):
        sp.gaussian_blur(fields, H, W, 4, 1.0)


def test_space_to_depth_and_back(spark):
    rows = [(c, i, j, float(c * 100 + i * 10 + j)) for c in range(3) for i in range(4) for j in range(6)]
    df = spark.createDataFrame(rows, "c int, i int, j int, value double")
    deep = sp.space_to_depth(df, 3, 2)
    want = {((i % 2 * 2 + j % 2) * 3 + c, i // 2, j // 2, v) for c, i, j, v in rows}
    assert {tuple(r) for r in deep.collect()} == want
    assert {tuple(r) for r in sp.depth_to_space(deep, 3, 2).collect()} == set(rows)


def test_colour_round_trip(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.2, 0.7, 0.9)], "r double, g double, b double")
    ycc = rgb_to_ycbcr(df)
    assert ycc.first().y == pytest.approx(0.2126) and ycc.first().cr == pytest.approx(1.0)
    back = ycbcr_to_rgb(ycc.select("y", "cb", "cr")).select("r", "g", "b").collect()
    for got, want in zip(back, df.collect()):
        assert list(got) == pytest.approx(list(want), abs=1e-9)


def test_latitude_weights_average_to_one(spark):
    w = [r.weight for r in sp.latitude_weights(spark.range(181).selectExpr("CAST(id AS INT) AS i"), 181).collect()]
    assert np.mean(w) == pytest.approx(1.0) and min(w) == 0.0
