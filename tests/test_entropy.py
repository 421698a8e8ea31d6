"""Symbol statistics against straightforward single-machine counting."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import entropy as en
from fieldloom.session import checkpointed
from fieldloom.operators.layout import field_to_cells

TOTAL = 65536


def brute_cdf(symbols, lo, hi):
    """Widths by rounding, at least 1, then pulled down from the top."""
    counts, n = Counter(symbols), len(symbols)
    size = hi - lo + 1
    cdf = [0] * size
    for k in range(1, size):
        share = counts[lo + k - 1] * ((TOTAL - 1) / n) if n else 0.0
        cdf[k] = cdf[k - 1] + max(1, int(math.floor(share + 0.5)))
    cdf[-1] = TOTAL
    for k in range(size - 2, 0, -1):
        cdf[k] = min(cdf[k], cdf[k + 1] - 1)
    return cdf


def brute_bits(groups, lo, hi):
    """Mean bits of lists of symbols, each coded with its own table."""
    bits = n = 0
    for symbols in groups:
        cdf = brute_cdf(symbols, lo, hi)
        for s in symbols:
            bits += 16 - math.log2(cdf[s - lo + 1] - cdf[s - lo])
            n += 1
    return bits / n


class Brute:
    def __init__(self, t):
        self.t = t  # [sample, channel, i, j]
        _, self.channels, self.h, self.w = t.shape
        self.lo = [int(t[:, c].min()) - 1 for c in range(self.channels)]
        self.hi = [int(t[:, c].max()) + 1 for c in range(self.channels)]
        self.mode = []
        for c in range(self.channels):
            cdf = brute_cdf(t[:, c].ravel().tolist(), self.lo[c], self.hi[c])
            self.mode.append(self.lo[c] + int(np.argmax(np.diff(cdf))))
        self.th = [self.best(c)[1] for c in range(self.channels)]

    def far(self, c, th):
        return (np.abs(self.t[:, c] - self.mode[c]) > th).astype(int)

    def ctx(self, c, th, prev=None):
        far = self.far(c, th)
        out = np.zeros_like(far)
        out[:, 1:, :] += far[:, :-1, :]
        out[:, :, 1:] += far[:, :, :-1]
        if prev is not None:
            out += self.far(prev, self.th[prev])
        return out

    def bits(self, c, ctx):
        x = self.t[:, c]
        return brute_bits([x[ctx == k].tolist() for k in range(4)], self.lo[c], self.hi[c])

    def best(self, c):
        limit = max(1, min(abs(self.lo[c] - self.mode[c]), abs(self.hi[c] - self.mode[c])))
        return min((round(self.bits(c, self.ctx(c, th)), 9), th) for th in range(limit))

    def gain(self, prev, c):
        plain = brute_bits([self.t[:, c].ravel().tolist()], self.lo[c], self.hi[c])
        return plain - self.bits(c, self.ctx(c, self.th[c], prev))

    def order(self):
        width = [self.hi[c] - self.lo[c] for c in range(self.channels)]
        placed = [max(range(self.channels), key=lambda c: (width[c], -c))]
        while True:
            rest = [c for c in range(self.channels) if c not in placed and width[c] > 4]
            if not rest:
                break
            placed.append(max(rest, key=lambda c: (round(self.gain(placed[-1], c), 9), -c)))
        return placed + [c for c in range(self.channels) if c not in placed]


@pytest.fixture(scope="module")
def tensor():
    rng = np.random.default_rng(11)
    samples, channels, h, w = 12, 70, 3, 5
    base = rng.normal(0, 1, (samples, 1, h, w))
    mix = rng.normal(0, 1, (samples, channels, h, w))
    spread = np.linspace(0.2, 3.5, channels)[None, :, None, None]
    return np.rint((base + mix) * spread).astype(int)


@pytest.fixture(scope="module")
def fields(spark, tensor):
    n, channels, h, w = tensor.shape
    rows = [
        (s, c, h, w, [int(x) for x in tensor[s, c].ravel()]) for s in range(n) for c in range(channels)
    ]
    return spark.createDataFrame(rows, "sample int, c int, h int, w int, values array<int>")


@pytest.fixture(scope="module")
def brute(tensor):
    return Brute(tensor)


@pytest.fixture(scope="module")
def model(spark, fields):
    hist = en.reused(en.symbol_histogram(field_to_cells(fields, ["sample", "c"], "sym")))
    support = checkpointed(en.symbol_support(hist))
    cdf = en.reused(en.symbol_cdf(hist, support=support))
    modes = en.reused(en.most_probable_symbol(cdf))
    thresholds = checkpointed(en.best_threshold(en.threshold_entropy(fields, modes, support)))
    return hist, support, cdf, modes, thresholds


def test_cdf_golden(spark):
    hist = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "c int, sym int, n bigint")
    rows = en.symbol_cdf(hist).orderBy("k").collect()
    # Support -1..2; 3/4 and 1/4 of 65535 round to 49151 and 16384.
    assert [(r.k, r.sym) for r in rows] == [(0, -1), (1, 0), (2, 1), (3, 2)]
    assert [r.cproba for r in rows] == [0, 1, 49152, 65536]
    assert [r.step for r in rows] == [1, 49151, 16384, None]


def test_cdf_pull_down(spark):
    # Many rare symbols push the sum of widths over the total.
    counts = {0: 1_000_000, **{k: 1 for k in range(1, 400)}}
    hist = spark.createDataFrame([(0, k, n) for k, n in counts.items()], "c int, sym int, n bigint")
    got = [r.cproba for r in en.symbol_cdf(hist).orderBy("k").collect()]
    n, f = sum(counts.values()), 65535 / sum(counts.values())
    want = [0]
    for k in range(-1, 400):
        want.append(want[-1] + max(1, int(math.floor(counts.get(k, 0) * f + 0.5))))
    want[-1] = TOTAL
    for k in range(len(want) - 2, 0, -1):
        want[k] = min(want[k], want[k + 1] - 1)
    assert got == want and n > 0
    assert all(b > a for a, b in zip(got, got[1:])) and got[-1] == TOTAL


def test_modes_and_cdf(model, brute):
    _, _, cdf, modes, _ = model
    assert {r.c: r.mode for r in modes.collect()} == dict(enumerate(brute.mode))
    by_channel = {}
    for r in cdf.orderBy("c", "k").collect():
        by_channel.setdefault(r.c, []).append(r.cproba)
    for c in range(brute.channels):
        assert by_channel[c] == brute_cdf(brute.t[:, c].ravel().tolist(), brute.lo[c], brute.hi[c])


def test_thresholds(model, brute):
    got = {r.c: (r.th, r.bits) for r in model[4].collect()}
    for c in range(brute.channels):
        bits, th = brute.best(c)
        assert got[c][0] == th
        assert got[c][1] == pytest.approx(bits, abs=1e-8)


def test_spatial_context_of_one_outlier(spark):
    fields = spark.createDataFrame([(0, 0, 3, 3, [0, 0, 0, 0, 9, 0, 0, 0, 0])],
                                   "sample int, c int, h int, w int, values array<int>")
    modes = spark.createDataFrame([(0, 0)], "c int, mode int")
    th = spark.createDataFrame([(0, 4)], "c int, th int")
    got = {(r.i, r.j): r.ctx for r in en.spatial_context(fields, modes, th).collect()}
    assert got == {(i, j): int((i, j) in ((2, 1), (1, 2))) for i in range(3) for j in range(3)}


def test_single_row_and_single_cell_fields(spark):
    fields = spark.createDataFrame([(0, 0, 1, 3, [5, 0, 5]), (1, 0, 1, 1, [5])],
                                   "sample int, c int, h int, w int, values array<int>")
    modes = spark.createDataFrame([(0, 0)], "c int, mode int")
    th = spark.createDataFrame([(0, 1)], "c int, th int")
    got = {(r.sample, r.j): r.ctx for r in en.spatial_context(fields, modes, th).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 0, (1, 0): 0}


def test_contexts(fields, model, brute):
    _, _, _, modes, thresholds = model
    got = {(r.sample, r.c, r.i, r.j): r.ctx for r in en.spatial_context(fields, modes, thresholds).collect()}
    for c in range(brute.channels):
        want = brute.ctx(c, brute.th[c])
        for at, x in np.ndenumerate(want):
            assert got[(at[0], c, at[1], at[2])] == x


def test_channel_context(spark, fields, model, brute):
    hist, support, _, modes, thresholds = model
    order = list(np.random.default_rng(2).permutation(brute.channels))
    table = spark.createDataFrame([(k, int(c)) for k, c in enumerate(order)], "pos int, c int")
    bits = en.channel_context_entropy(fields, modes, thresholds, table, support)
    got = {r.c: r.bits for r in bits.collect()}
    for k, c in enumerate(order):
        prev = order[k - 1] if k else None
        assert got[c] == pytest.approx(brute.bits(c, brute.ctx(c, brute.th[c], prev)), abs=1e-9)


def test_negative_previous_threshold_means_own(spark):
    fields = spark.createDataFrame([(0, 0, 1, 2, [3, 0]), (0, 1, 1, 2, [0, 0])],
                                   "sample int, c int, h int, w int, values array<int>")
    modes = spark.createDataFrame([(0, 0), (1, 0)], "c int, mode int")
    order = spark.createDataFrame([(0, 0), (1, 1)], "pos int, c int")
    for own, want in ((2, 1), (3, 0)):
        th = spark.createDataFrame([(0, -1), (1, own)], "c int, th int")
        rows = en.channel_context(fields, modes, th, order).where("c = 1 AND j = 0").collect()
        assert rows[0].ctx == want


def test_gains_and_order(fields, model, brute):
    hist, support, cdf, modes, thresholds = model
    # More than 63 wide channels, so the flags need two words.
    wide = [c for c in range(brute.channels) if brute.hi[c] - brute.lo[c] > 4]
    assert len(wide) > 63
    gains = checkpointed(en.channel_gains(fields, modes, thresholds, support, en.cross_entropy(hist, cdf)))
    got = {(r.prev, r.c): r.gain for r in gains.collect()}
    assert len(got) == len(wide) * (len(wide) - 1)
    rng = np.random.default_rng(3)
    for _ in range(150):
        p, c = rng.choice(wide, 2, replace=False)
        assert got[(p, c)] == pytest.approx(brute.gain(p, c), abs=1e-9)
    placed = [r.c for r in en.channel_order(support, gains).orderBy("pos").collect()]
    assert placed == brute.order()


def test_activation(fields, model, brute):
    got = {r.c: r.proba for r in en.channel_activation(fields, model[3]).collect()}
    for c in range(brute.channels):
        on = (brute.t[:, c] != brute.mode[c]).any(axis=(1, 2)).sum()
        share = int(math.floor(on * (TOTAL / brute.t.shape[0]) + 0.5))
        assert got[c] == max(1, min(TOTAL - 1, share))


def brute_pmf_to_cdf(pmf):
    """Edges by rounding; an empty bin shifts the edges between it and its donor."""
    freq = [math.floor(p * TOTAL + 0.5) for p in pmf]
    total, edges = sum(freq), [0]
    for f in freq:
        edges.append(edges[-1] + f * TOTAL // total)
    edges[-1] = TOTAL
    for i in range(len(pmf)):
        if edges[i] == edges[i + 1]:
            widths = [(edges[j + 1] - edges[j], j) for j in range(len(pmf)) if edges[j + 1] - edges[j] > 1]
            donor = min(widths)[1]
            if donor < i:
                for j in range(donor + 1, i + 1):
                    edges[j] -= 1
            else:
                for j in range(i + 1, donor + 1):
                    edges[j] += 1
    return edges


def test_pmf_to_cdf(spark):
    rng = np.random.default_rng(5)
    tables = {}
    for c in range(12):
        p = rng.gamma(0.05, 1.0, 40)
        tables[c] = (p / p.sum()).tolist()
    rows = [(c, k, p) for c, t in tables.items() for k, p in enumerate(t)]
    got = {}
    for r in en.pmf_to_cdf(spark.createDataFrame(rows, "c int, k int, p double")).orderBy("c", "k").collect():
        got.setdefault(r.c, []).append(r.cproba)
    for c, t in tables.items():
        assert got[c] == brute_pmf_to_cdf(t)
        assert all(b > a for a, b in zip(got[c], got[c][1:]))


@pytest.mark.parametrize("bad", [[0.5, -0.1], [0.5, float("nan")], [0.0, 0.0]])
def test_pmf_rejects(spark, bad):
    df = spark.createDataFrame([(0, k, p) for k, p in enumerate(bad)], "c int, k int, p double")
    with pytest.raises(Exception, match="pmf"):
        en.pmf_to_cdf(df).collect()


def test_symbol_out_of_range(spark):
    hist = spark.createDataFrame([(0, -32768, 1)], "c int, sym int, n bigint")
    with pytest.raises(Exception, match="out of range"):
        en.symbol_support(hist).collect()


def test_histogram_totals(fields, model):
    assert model[0].agg(F.sum("n")).first()[0] == fields.select(F.explode("values")).count()


def test_edges_match_a_plain_loop():
    from fieldloom.operators.tables import edges

    rng = np.random.default_rng(5)
    for size, total in [(1, 65536), (7, 65536), (200, 256), (255, 256), (40, 65536)]:
        counts = rng.integers(0, 50, size) * rng.integers(0, 2, size)
        whole = int(counts.sum())
        want = [0]
        for n in counts:
            share = int(n) * ((total - 1) / whole) if whole else 0.0
            want.append(want[-1] + max(1, math.floor(share) + (share - math.floor(share) >= 0.5)))
        want[-1] = total
        for k in range(size - 1, 0, -1):
            want[k] = min(want[k], want[k + 1] - 1)
        assert edges(counts, whole, total).tolist() == want


def test_bits_of_own_tables_match_the_join(spark):
    rows = [(c, x, s, n) for c in (0, 1) for x in (0, 1) for s, n in [(-3, 2), (0, 40 + c), (4, 1 + x), (None, 5)]]
    hist = spark.createDataFrame([*rows, (1, 2, None, 7)], "c int, ctx int, sym int, n long")
    support = en.symbol_support(hist.where("sym < 4"))  # the symbol 4 has no place in the tables
    cdf = en.symbol_cdf(hist, ["c", "ctx"], support)
    want = {r["c"]: r for r in en.weighted_bits(hist, cdf, ["c", "ctx"], ["c"]).collect()}
    got = {r["c"]: r for r in en.own_bits(hist, ["c", "ctx"], ["c"], support).collect()}
    assert got.keys() == want.keys() == {0, 1}
    for c in want:
        assert got[c]["bits"] == pytest.approx(want[c]["bits"])
        assert (got[c]["n"], got[c]["n_unpriced"]) == (want[c]["n"], want[c]["n_unpriced"])
