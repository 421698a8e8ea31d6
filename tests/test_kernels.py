"""Formulas on packed fields against plain loops, at block borders and on odd input."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions.numeric import erfc_array
from fieldloom.operators import kernels as kn

NAN = float("nan")
FIELDS = "k int, values array<double>, scales array<double>, m double"


def test_erfc_array():
    x = np.concatenate([np.linspace(-7, 20, 5001), [0.46875, -0.46875, 4.0, -4.0, np.inf, -np.inf]])
    want = np.array([math.erfc(v) for v in x])
    assert np.allclose(erfc_array(x), want, rtol=1e-12, atol=0)
    assert np.isnan(erfc_array(np.array([NAN]))).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=12), st.integers(1, 7))
def test_blocks_do_not_change_results(sizes, cells):
    rows = [None if n is None else [float(k) for k in range(n)] for n in sizes]
    numbers = [float(10 * i) for i in range(len(rows))]
    lined = kn.Aligned([pa.array(rows, pa.list_(pa.float64())), pa.array(numbers, pa.float64())])
    before, kn.CELLS = kn.CELLS, cells
    try:
        got = lined.lists(lined.each(lambda x, m: x + m), pa.float64()).to_pylist()
    finally:
        kn.CELLS = before
    assert got == [None if r is None else [x + m for x in r] for r, m in zip(rows, numbers)]


def test_null_and_empty_fields(spark):
    rows = [(0, None, [1.0], 0.0), (1, [], [], 0.0), (2, [1.4, None, NAN, 3e9], [1.0] * 4, 0.0), (3, [2.6], [None], None), (4, [1.0], None, 0.0)]
    fields = spark.createDataFrame(rows, FIELDS)
    out = fields.select("k", kn.quantize_symbols_fields("values", "m").alias("s"),
                        kn.likelihood_fields("values", "scales", "m").alias("l"), kn.field_bits("values", "scales", "m").alias("b"))
    got = {r.k: r for r in out.collect()}
    assert [got[k].s for k in range(5)] == [None, [], [1, None, None, None], [None], [1]]
    assert got[0].l is None and got[4].l is None and got[1].l == [] and got[3].l == [None]
    assert [x is None for x in got[2].l] == [False, True, True, False]
    want = -sum(math.log2(x) for x in got[2].l if x is not None)
    assert got[2].b.bits == pytest.approx(want) and got[2].b.n_null == 2
    assert got[3].b.bits is None and got[3].b.n_null == 1
    assert out.where("false").count() == 0


def test_lists_of_other_sizes_are_errors(spark):
    fields = spark.createDataFrame([(0, [1.0, 2.0], [1.0], 0.0)], FIELDS)
    with pytest.raises(Exception, match="differ in size"):
        fields.select(kn.likelihood_fields("values", "scales")).collect()


def test_field_stats_do_not_cancel_and_hand_on(spark, monkeypatch):
    rows = [(i % 5, [1e9 + i, 1e9 - i, None, NAN], None, 0.0) for i in range(200)] + [(9, None, None, 0.0), (7, [None, NAN], None, 0.0), (8, [], None, 0.0)]
    fields = spark.createDataFrame(rows, FIELDS).repartition(7)
    monkeypatch.setattr(kn, "HELD", 2)
    got = {r.k: r for r in kn.field_stats(fields, ["k"]).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 7, 8}
    for k in range(5):
        x = np.array([v for i in range(200) if i % 5 == k for v in (1e9 + i, 1e9 - i)])
        assert (got[k].n, got[k].n_null) == (80, 80)
        assert got[k].mean == pytest.approx(x.mean(), rel=1e-15) and got[k].std == pytest.approx(x.std(), rel=1e-9)
    assert (got[7].n, got[7]["mean"], got[7]["std"], got[7].n_null) == (0, None, None, 2)
    assert (got[8].n, got[8].n_null) == (0, 0)
    assert kn.field_stats(fields.where("false"), ["k"]).count() == 0


def test_field_stats_shuffle_once(spark):
    fields = spark.createDataFrame([(0, [1.0], None, 0.0)], FIELDS)
    text = kn.field_stats(fields, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line for line in text.splitlines()) == 1


def test_round_trip_with_statistics(spark):
    rows = [(0, [1.0, None, 3.0], None, 0.0), (1, [5.0, 5.0], None, 0.0), (2, [1.0], None, 0.0)]
    fields = spark.createDataFrame(rows, FIELDS)
    stats = kn.field_stats(fields.where("k < 2"), ["k"])
    scaled = kn.standardize_fields(fields, stats, "k")
    assert {r.k: r["values"] for r in scaled.collect()} == {0: [-1.0, None, 1.0], 1: [None, None], 2: [None]}
    back = kn.destandardize_fields(scaled, stats, "k")
    assert {r.k: r["values"] for r in back.collect()} == {0: [1.0, None, 3.0], 1: [None, None], 2: [None]}
    assert back.columns == ["k", *[c for c in FIELDS.replace(",", "").split() if c in ("values", "scales", "m")]]
    assert back.select(F.size("values")).count() == 3
