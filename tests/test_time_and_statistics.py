import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import channels as ch
from fieldloom.operators import scoring as sc
from fieldloom.operators import packed, scan
from fieldloom.operators import statistics as st
from fieldloom.operators import timeaxis as tx
from fieldloom.operators.layout import cells_to_field
from fieldloom.sizing import reused, running_sums

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def times(spark, hours):
    return spark.createDataFrame([(T0 + h * HOUR,) for h in hours], "ts timestamp_ntz")


def test_targets_count_from_the_last_input(spark):
    rows = tx.lead_pairs(times(spark, [0]), [0, 6], [6, 24]).orderBy("role", "k").collect()
    got = [(r.role, r.k, (r.valid_ts - T0) // HOUR) for r in rows]
    assert got == [("input", 0, 0), ("input", 1, 6), ("target", 0, 12), ("target", 1, 30)]


def test_negative_input_offsets(spark):
    rows = tx.lead_pairs(times(spark, [48]), [-6, 0], [1]).orderBy("valid_ts").collect()
    assert [(r.valid_ts - T0) // HOUR for r in rows] == [42, 48, 49]


@pytest.mark.parametrize("inputs,targets,step,lost", [([0], [6], 6, 1), ([0, 6], [6, 24], 6, 5), ([0], [1], 6, 1), ([0], [0], 1, 0)])
def test_valid_anchors(spark, inputs, targets, step, lost):
    hours = list(range(0, 120, step))
    kept = tx.valid_anchors(times(spark, hours), inputs, targets, step).collect()
    assert sorted((r.ts - T0) // HOUR for r in kept) == (hours[:-lost] if lost else hours)


def test_valid_anchors_on_a_short_axis(spark):
    assert tx.valid_anchors(times(spark, [0, 6]), [0, 6], [6, 24], 6).count() == 0


def test_limit_anchors(spark):
    axis = times(spark, range(10))
    assert sorted((r.ts - T0) // HOUR for r in tx.limit_anchors(axis, 3, "keep").collect()) == [0, 1, 2]
    assert sorted((r.ts - T0) // HOUR for r in tx.limit_anchors(axis, 3, "skip").collect()) == list(range(3, 10))
    assert tx.limit_anchors(axis, 0, "skip").count() == 10
    with pytest.raises(ValueError):
        tx.limit_anchors(axis, 3, "other")


def test_timestamp_grid_ends_at_23(spark):
    bounds = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 2))], "start date, end date")
    got = sorted((r.ts - T0) // HOUR for r in tx.timestamp_grid(bounds, 9).collect())
    assert got == list(range(0, 48, 9))


def test_date_split_includes_the_last_hour(spark):
    ts = [dt.datetime(2017, 12, 31, 23), dt.datetime(2018, 1, 1), dt.datetime(2018, 12, 31, 23), dt.datetime(2019, 1, 1)]
    df = spark.createDataFrame([(t, t.year) for t in ts], "ts timestamp_ntz, year int")
    assert [tx.date_split(df, s).count() for s in ("train", "val", "test")] == [1, 2, 2]
    with pytest.raises(ValueError):
        tx.date_split(df, "other")


@pytest.mark.parametrize("interval,n,window", [(10, 20, 2), (3, 12, 3), (1, 5, 1), (7, 4, 4)])
def test_curriculum_matches_the_stateful_loop(spark, interval, n, window):
    want, turns = [], 0
    for it in range(1, 301):
        stage = max(((it + interval) // interval) % (n // window), 1)
        if it % 2:
            turns += 1
            stage = max(turns % stage, 1)
        want.append((it, stage, (stage - 1) * window, stage * window))
    its = spark.range(1, 301).withColumnRenamed("id", "iteration")
    rows = tx.lead_curriculum(its, interval, n, window).orderBy("iteration").collect()
    assert [(r.iteration, r.stage, r.first, r.last) for r in rows] == want


def test_every_kth_step(spark):
    df = spark.createDataFrame([(run, h) for run in "ab" for h in range(0, 60, 6)], "run string, step int")
    got = tx.every_kth_step(df, ["run"], "step", 2, 2, 3).collect()
    assert sorted((r.run, r.step, r.slot) for r in got) == [
        (run, s, k) for run in "ab" for k, s in enumerate((12, 24, 36))
    ]
    assert tx.every_kth_step(df, ["run"], "step", 0, 1, 0).count() == 0


def test_accumulate_across_chunks_and_gaps(spark):
    rng = np.random.default_rng(0)
    hours = [h for h in range(200) if h % 37]
    values = {h: float(rng.integers(0, 100)) for h in hours}
    df = spark.createDataFrame([(T0 + h * HOUR, "k", values[h]) for h in hours], "ts timestamp_ntz, c string, value double")
    for chunk in (6, 13, 500):
        got = {(r.ts - T0) // HOUR: r.accumulated for r in tx.accumulate_hours(df, 6, ["c"], chunk_hours=chunk).collect()}
        assert set(got) == set(hours)
        for h in hours:
            span = [values.get(x) for x in range(h - 5, h + 1)]
            assert got[h] == (None if None in span else sum(span))


def test_running_sums_do_not_depend_on_the_block(spark):
    rng = np.random.default_rng(1)
    # One key holds most rows; order values are sparse and partly negative.
    rows = [("hot", int(o), float(rng.normal())) for o in rng.choice(np.arange(-4000, 4000), 3000, replace=False)]
    rows += [("cold", int(o), 1.0) for o in range(5)]
    pdf = pd.DataFrame(rows, columns=["k", "o", "x"]).sort_values(["k", "o"])
    pdf["s"] = pdf.groupby("k")["x"].cumsum()
    want = {(r.k, r.o): r.s for r in pdf.itertuples()}
    df = spark.createDataFrame(rows, "k string, o long, x double")
    for block, depth in ((7, 2), (64, 3), (10_000, 1)):
        got = {(r.k, r.o): r.s for r in running_sums(df, ["k"], "o", {"s": F.col("x")}, block, depth).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_cumulative_mse_skips_unreadable_files(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, None), (3, 4.0)], "seq long, mse double")
    rows = st.cumulative_mse(df, "seq", block=2).orderBy("seq").collect()
    assert [r.running_mse for r in rows] == [0.0, 2.0, 2.0, 3.0]


@pytest.mark.parametrize("warmup", [True, False])
def test_ema_matches_the_loop(spark, warmup):
    rng = np.random.default_rng(2)
    rows = [("hot", int(o), float(rng.normal())) for o in sorted(rng.choice(3000, 900, replace=False))]
    rows += [("cold", 5, 1.0)]
    want = {}
    for key in ("hot", "cold"):
        s = None
        for n, (_, o, x) in enumerate([r for r in rows if r[0] == key]):
            d = min(0.995, (1 + n) / (10 + n)) if warmup else 0.995
            s = x if s is None else s - (1 - d) * (s - x)
            want[key, o] = s
    df = spark.createDataFrame(rows, "key string, seq long, value double").repartition(5)
    for block in (50, 100_000):
        got = {(r.key, r.seq): r.ema for r in st.ema(df, 0.995, warmup, block=block).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_scan_over_many_levels(spark, monkeypatch):
    """Blocks of two rows in groups of four, NULL keys, gaps in the order, missing values."""
    monkeypatch.setattr(scan, "LEVEL", 2)
    rng = np.random.default_rng(4)
    rows = [(k, int(o) ** 3, None if o % 5 == 0 else float("nan") if o % 7 == 0 else float(o % 11)) for k in ("a", None) for o in rng.choice(400, 150, replace=False)]
    df = spark.createDataFrame(rows, "key string, seq long, value double").repartition(3)
    sums, state = {}, {}
    for key in ("a", None):
        s = n = 0
        ema = None
        for _, o, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if x is not None and x == x:
                d = min(0.99, (1 + n) / (10 + n)) if n else 0.0
                ema = x if ema is None else ema - (1 - d) * (ema - x)
                s, n = s + x, n + 1
            sums[key, o] = s / n if n else 0.0
            state[key, o] = ema
    got = {(r.key, r.seq): r.running_mse for r in st.cumulative_mse(df, "seq", "value", ["key"], block=2).collect()}
    assert got == pytest.approx(sums, abs=1e-12)
    got = {(r.key, r.seq): r.ema for r in st.ema(df, 0.99, block=2).collect()}
    assert got.keys() == state.keys()
    assert all(got[k] is None if s is None else got[k] == pytest.approx(s, abs=1e-12) for k, s in state.items())
    assert st.ema(df.limit(0), 0.99).count() == 0 and st.cumulative_mse(df.limit(0), "seq", "value").count() == 0


def test_accumulated_fields(spark):
    """Chunks, halos, missing hours, fields and cells, against adding up each window."""
    rng = np.random.default_rng(8)
    start = dt.datetime(2020, 1, 1)
    series = {}
    for key in ("a", None):
        for h in range(60):
            if h % 13 != 5:
                cells = [None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(x) for x in rng.normal(size=3)]
                series[key, h] = None if h % 17 == 9 else cells
    rows = [(k, start + dt.timedelta(hours=h), x) for (k, h), x in series.items()]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, values array<double>").repartition(4)
    for chunk in (4, 7, 720):
        got = {(r["key"], r["ts"]): r["accumulated"] for r in tx.accumulate_fields(df, 4, ["key"], chunk_hours=chunk).collect()}
        assert len(got) == len(rows)
        for key, ts, _ in rows:
            h = int((ts - start).total_seconds() // 3600)
            window = [series.get((key, h - d)) for d in range(4)]
            if any(x is None for x in window):
                assert got[key, ts] is None
                continue
            for cells, total in zip(zip(*window), got[key, ts]):
                bad = any(x is None or x != x for x in cells)
                assert total is None if bad else total == pytest.approx(sum(cells), abs=1e-12)


def test_stacked_fields(spark):
    rows = [(s, c, 2, 3, [float(100 * s + 10 * c + k) if k != s else None for k in range(6)]) for s in range(3) for c in (5, 1, 9) if (s, c) != (2, 9)]
    df = spark.createDataFrame(rows, "sample int, channel_idx int, h int, w int, values array<double>").repartition(3)
    for band in (1, 4, 1 << 14):
        got = {(r["sample"], r["i"], r["j"]): (r["channels"], r["values"]) for r in ch.stack_fields(df, ["sample"], band=band).collect()}
        assert len(got) == 18
        for (s, i, j), (channels, values) in got.items():
            assert channels == ([1, 5] if s == 2 else [1, 5, 9])
            assert values == [None if 3 * i + j == s else 100.0 * s + 10 * c + 3 * i + j for c in channels]
    with pytest.raises(Exception, match="repeated"):
        ch.stack_fields(df.union(df.limit(1)), ["sample"]).collect()
    cells = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0)], "k int, channel_idx int, value double")
    with pytest.raises(Exception, match="repeated"):
        ch.stack_channels(cells, ["k"]).collect()


def test_field_means_in_parts(spark, monkeypatch):
    """Many keys, few held at a time, missing cells, NULL fields."""
    monkeypatch.setattr(packed, "HELD", 2)
    monkeypatch.setattr(packed, "BYTES", 100)
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(7)) or None, [None if rng.random() < 0.3 else float("nan") if rng.random() < 0.1 else float(x) for x in rng.normal(size=5)]) for _ in range(200)]
    df = spark.createDataFrame([*rows, (99, None), (3, None)], "k int, values array<double>").repartition(4)
    want = {}
    for key in {k for k, _ in rows}:
        cells = zip(*(v for k, v in rows if k == key))
        there = [[x for x in c if x is not None and x == x] for c in cells]
        want[key] = [sum(c) / len(c) if c else None for c in there]
    got = {r["k"]: r["values"] for r in packed.field_means(df, ["k"]).collect()}
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(w, abs=1e-12) for k in want for g, w in zip(got[k], want[k]))
    with pytest.raises(Exception, match="differ in size"):
        packed.field_means(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], df.schema), ["k"]).collect()


def test_statistics_skip_missing_cells(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, None), (0, float("nan"))], "channel_idx int, value double")
    r = st.channel_stats(df).first()
    assert (r.n, r.mean, r.std, r.n_null) == (2, 2.0, 1.0, 2)


def test_merged_statistics_equal_the_whole(spark):
    rng = np.random.default_rng(3)
    # A large offset, where squares would cancel.
    df = spark.createDataFrame(
        [(int(c), int(p), float(1e7 + rng.normal())) for c in (0, 1) for p in range(4) for _ in range(50)],
        "channel_idx int, part int, value double",
    )
    whole = {r.channel_idx: r for r in st.channel_stats(df).collect()}
    merged = st.merge_stats(st.channel_stats(df, ["part", "channel_idx"])).collect()
    for r in merged:
        assert r.n == whole[r.channel_idx].n
        assert r.mean == pytest.approx(whole[r.channel_idx].mean, abs=1e-6)
        assert r.std == pytest.approx(whole[r.channel_idx].std, rel=1e-6)


def test_standardize_round_trip_and_constant_channel(spark):
    cells = spark.createDataFrame([(0, 1.0), (0, 5.0), (1, 7.0)], "channel_idx int, value double")
    stats = st.channel_stats(cells)
    scaled = st.standardize(cells, stats)
    assert scaled.where("channel_idx = 1").first().value is None
    back = st.destandardize(scaled.where("channel_idx = 0"), stats)
    assert sorted(r.value for r in back.collect()) == [1.0, 5.0]
    with pytest.raises(ValueError):
        st.standardize(cells, stats, "other")


def test_minmax_store(spark):
    fields = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 4.0, 4.0])], "k int, values array<double>")
    q = st.minmax_quantize(fields, 255).orderBy("k").collect()
    assert [list(r["values"]) for r in q] == [[0, 127, 255], [0, 0, 0]]
    assert [(r.shift, r.scale) for r in q] == [(1.0, 2.0), (4.0, 0.0)]
    back = st.minmax_dequantize(st.minmax_quantize(fields, 65535)).orderBy("k").collect()
    assert max(abs(a - b) for a, b in zip(back[0]["values"], [1.0, 2.0, 3.0])) <= 2 / 65535
    assert list(back[1]["values"]) == [4.0, 4.0, 4.0]


def test_overflow_is_flagged(spark):
    from fieldloom.operators.quantise import center_latent

    cells = spark.createDataFrame([(0, 40000.0), (0, -32768.4)], "c int, y double")
    means = spark.createDataFrame([(0, 0.0)], "c int, mean double")
    assert sorted((r.centered is None, r.overflow) for r in center_latent(cells, means).collect()) == [(False, False), (True, True)]


def test_channel_dim_has_268_channels_in_order(spark):
    rows = ch.channel_dim(ch.channel_config(spark)).orderBy("channel_idx").collect()
    assert [r.channel_idx for r in rows] == list(range(7 * 37 + 9))
    assert (rows[0].name, rows[36].name, rows[37].name, rows[-1].name) == ("z_1000", "z_1", "q_1000", "msl")
    assert rows[-1].level is None


def test_split_moments_clamps(spark):
    rows = [(0, c, 0, 0, y) for c, y in enumerate([1.0, 2.0, -99.0, 99.0])]
    cells = spark.createDataFrame(rows, "sample int, c int, i int, j int, y double")
    got = {r.c: (r.mean, r.logvar) for r in ch.split_moments(cells, 2).collect()}
    assert got == {0: (1.0, -30.0), 1: (2.0, 20.0)}


def test_field_shapes_must_agree(spark):
    a = spark.createDataFrame([(0, 2, [1.0, 2.0])], "k int, w int, values array<double>")
    b = spark.createDataFrame([(0, 2, [1.0])], "k int, w int, values array<double>")
    with pytest.raises(Exception, match="shapes differ"):
        ch.pair_fields(a, b, ["k"]).collect()


def test_weighted_scores(spark):
    rng = np.random.default_rng(4)
    h, days = 5, 6
    rows = [(T0 + d * 24 * HOUR, "z", i, *map(float, rng.normal(size=3))) for d in range(days) for i in range(h)]
    pairs = spark.createDataFrame(rows, "valid_ts timestamp_ntz, channel string, i int, pred double, truth double, clim double")
    a = np.array([r[3:] for r in rows]).reshape(days, h, 3)
    cos = np.array([0.0 if i in (0, h - 1) else math.cos(math.radians(90 - 45 * i)) for i in range(h)])
    w = cos / cos.mean()
    rmse = np.sqrt((w * (a[..., 0] - a[..., 1]) ** 2).sum(1) / w.sum()).mean()
    p, t = a[..., 0] - a[..., 2], a[..., 1] - a[..., 2]
    acc = ((w * p * t).sum(1) / np.sqrt((w * p * p).sum(1) * (w * t * t).sum(1))).mean()
    assert sc.weighted_rmse(pairs, h, ["channel"]).first().wrmse == pytest.approx(rmse)
    assert sc.anomaly_correlation(pairs, h, ["channel"]).first().acc == pytest.approx(acc)


def test_closest_quality_ties_and_missing(spark):
    df = spark.createDataFrame([("x", 3, 31.0), ("x", 1, 29.0), ("x", 2, None)], "item string, qp int, value double")
    r = sc.closest_quality(df, 30.0, ["item"]).first()
    assert (r.qp, r.gap) == (1, 1.0)


def test_sweep_average_divides_by_the_file_count(spark):
    runs = spark.createDataFrame([("a", 1, "psnr", "f1", 30.0)], "codec string, qp int, metric string, item string, value double")
    files = spark.createDataFrame([("f1",), ("f2",)], "item string")
    assert sc.sweep_average(runs, files).first().value == 15.0


def test_pending_runs(spark):
    work = spark.createDataFrame([(1,), (2,)], "item int")
    done = spark.createDataFrame([(1,)], "item int")
    assert [r.item for r in sc.pending_runs(work, done, ["item"]).collect()] == [2]
    assert sc.pending_runs(work, done, ["item"], force=True).count() == 2


def test_psnr_of_equal_images_is_infinite(spark):
    df = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.5, 2.0)], "k int, orig double, recon double")
    got = {r.k: r.psnr for r in sc.psnr(df, ["k"]).collect()}
    assert got[0] == math.inf
    # 0.5 -> 128 (half to even), 2.0 clamps to 255.
    assert got[1] == pytest.approx(20 * math.log10(255) - 10 * math.log10(127**2))


def test_reused_summaries_are_lazy_and_whole(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    kept = reused(df)
    assert {(r.k, r["count"]) for r in kept.collect()} == {(r.k, r["count"]) for r in df.collect()}
    assert kept.storageLevel.useDisk and kept.storageLevel.useMemory
    kept.unpersist()


def test_missing_cells_never_count(spark):
    nan = float("nan")
    pairs = spark.createDataFrame([(0, None, 0.0), (0, nan, 1.0), (0, 0.5, 0.5), (1, None, nan)], "k int, orig double, recon double")
    got = {r.k: r for r in sc.channel_error_table(pairs, ["k"]).collect()}
    assert (got[0].rmse, got[0].n, got[0].n_null) == (0.0, 1, 2) and (got[1].rmse, got[1].n, got[1].n_null) == (None, 0, 1)
    assert {r.k: r.mse for r in sc.psnr(pairs, ["k"]).collect()} == {0: 0.0, 1: None}
    rows = [(t, i, float(t + i), float(t + i) if i else None, 1.0) for t in range(2) for i in range(3)]
    acc = sc.anomaly_correlation(spark.createDataFrame(rows, "valid_ts int, i int, pred double, truth double, clim double"), 5, []).first()
    assert acc.acc == pytest.approx(1.0) and acc.n_times == 2


def test_packed_fields_with_missing_cells(spark):
    nan = float("nan")
    fields = spark.createDataFrame([(0, [1.0, nan, 3.0, None]), (0, [None, nan]), (1, [2.0, 2.0])], "c int, values array<double>")
    got = [r["values"] for r in st.minmax_quantize(fields, 10).collect()]
    assert got == [[0, None, 10, None], [None, None], [0, 0]]
    assert {r.c: r["mean"] for r in st.latent_channel_means(fields).collect()} == {0: 2.0, 1: 2.0}


def test_statistics_keep_all_channels_and_cells(spark):
    cells = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, None), (2, 5.0)], "channel_idx int, value double")
    stats = st.channel_stats(cells.where("channel_idx < 2"))
    merged = {r.channel_idx: (r.n, r["mean"], r["std"], r.n_null) for r in st.merge_stats(stats).collect()}
    assert merged == {0: (2, 2.0, 1.0, 0), 1: (0, None, None, 1)}
    scaled = st.standardize(cells, stats)
    assert sorted((r.channel_idx, r.value or 0) for r in scaled.collect()) == [(0, -1.0), (0, 1.0), (1, 0), (2, 0)]


def test_sweep_average_of_the_file_set(spark):
    runs = spark.createDataFrame([("x", 1, "m", k, 2.0) for k in range(5)], "codec string, qp int, metric string, item int, value double")
    files = spark.createDataFrame([(0,), (1,)], "item int")
    assert [r.value for r in sc.sweep_average(runs, files).collect()] == [2.0]


def test_repeated_cells_are_an_error(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 9.0), (0, 0, 1, 2.0), (0, 1, 1, 3.0)], "k int, i int, j int, value double")
    with pytest.raises(Exception, match="repeated"):
        cells_to_field(cells, ["k"], 2, 2).collect()
