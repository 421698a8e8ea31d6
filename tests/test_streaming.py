import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import statistics as st
from fieldloom.streaming import scores as ss
from fieldloom.streaming import units as un

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = dt.timedelta(hours=1)


class Feed:
    """A folder read as a stream, one file per batch, in order."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def add(self, rows):
        part = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        part.write.mode("append").parquet(f"{self.path}/{self.n:03d}")
        self.n += 1

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False)
        return reader.parquet(f"{self.path}/*")


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, un.STATE_STORE)
    yield
    spark.conf.set(key, before)


def test_assembly(spark, tmp_path, rocksdb):
    feed = Feed(spark, str(tmp_path / "in"), "ts timestamp, unit string")
    t = [T0 + k * HOUR for k in range(20)]
    feed.add([(t[0], "a"), (t[0], "a"), (t[0], "b"), (t[1], "a")])  # duplicates; nothing complete yet
    feed.add([(t[0], "c"), (t[1], "c"), (t[1], "c"), (t[2], "b")])  # t0 complete, in any order
    feed.add([(t[0], "b"), (t[1], "b"), (t[3], "a")])  # a late copy of t0; t1 complete
    feed.add([(t[12], "a")])  # far ahead: t2 and t3 time out in the next batch
    feed.add([(t[12], "a")])
    feed.add([(t[2], "a"), (t[2], "c"), (t[13], "a")])  # too late for t2
    feed.add([(t[13], "b"), (t[13], "c")])
    out = ss.drain(un.assemble_stream(feed.stream(), 3, 2)).collect()
    got = sorted((round((r.ts.astimezone(dt.timezone.utc) - T0) / HOUR), r.arrived, r.complete) for r in out)
    assert got == [(0, 3, True), (1, 3, True), (2, 1, False), (3, 1, False), (13, 3, True)]


def test_units_count_until_the_deadline(spark, tmp_path, rocksdb):
    """The watermark passes a sample's timestamp long before its deadline."""
    feed = Feed(spark, str(tmp_path / "in"), "ts timestamp, unit string")
    t = [T0 + k * HOUR for k in range(20)]
    feed.add([(t[0], "a"), (t[0], "b")])
    feed.add([(t[2], "a")])
    feed.add([(t[3], "a")])
    feed.add([(t[0], "c")])  # three hours late, within the six allowed
    feed.add([(t[19], "a")])
    feed.add([(t[19], "b")])
    out = ss.drain(un.assemble_stream(feed.stream(), 3, 6)).collect()
    got = sorted((round((r.ts.astimezone(dt.timezone.utc) - T0) / HOUR), r.arrived, r.complete) for r in out)
    assert got[:3] == [(0, 3, True), (2, 1, False), (3, 1, False)]


def test_running_statistics_equal_the_batch(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"), "channel_idx int, value double")
    batches = [[(0, 1.0), (1, 5.0), (0, None)], [(0, 2.0), (0, float("nan"))], [(1, 9.0), (0, 7.0)]]
    for b in batches:
        feed.add(b)
    got = ss.drain(ss.running_stats_stream(feed.stream()), "complete").collect()
    want = st.channel_stats(spark.createDataFrame([r for b in batches for r in b], feed.schema)).collect()
    assert len(got) == len(want) == 2
    for a, b in zip(sorted(map(tuple, got)), sorted(map(tuple, want))):
        assert a == pytest.approx(b)


def test_standardize_equals_the_batch(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"), "channel_idx int, value double")
    rows = [(0, 1.0), (0, 3.0), (1, 5.0), (1, 9.0)]
    feed.add(rows[:1])
    feed.add(rows[1:])
    stats = st.channel_stats(spark.createDataFrame(rows, feed.schema))
    got = ss.drain(ss.standardize_stream(feed.stream(), stats)).collect()
    assert sorted(map(tuple, got)) == [(0, -1.0), (0, 1.0), (1, -1.0), (1, 1.0)]


def test_windowed_error_drops_late_rows(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"), "ts timestamp, orig double, recon double")
    feed.add([(T0, 1.0, 0.0), (T0 + HOUR, 3.0, 0.0)])
    feed.add([(T0 + 10 * HOUR, 1.0, 0.0)])
    feed.add([(T0 + 10 * HOUR, 3.0, 0.0)])  # Spark drops by the watermark of the batch before
    feed.add([(T0, 100.0, 0.0)])  # late
    feed.add([(T0 + 30 * HOUR, 0.0, 0.0)])
    out = ss.drain(ss.windowed_error_stream(feed.stream(), "2 hours")).collect()
    got = sorted((round((r.start.astimezone(dt.timezone.utc) - T0) / HOUR), r.mse, r.n) for r in out)
    assert got == [(0, 5.0, 2), (10, 5.0, 2)]


def test_sliding_windows(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"), "ts timestamp, orig double, recon double")
    feed.add([(T0 + HOUR, 2.0, 0.0)])
    feed.add([(T0 + 40 * HOUR, 0.0, 0.0)])
    out = ss.drain(ss.windowed_error_stream(feed.stream(), "4 hours", "2 hours"))
    assert out.where(F.col("mse") == 4.0).count() == 2


def test_stored_stats_survive_a_restart(spark, tmp_path, monkeypatch):
    """A batch that fails after it was stored, and one that fails before, are each counted once."""
    feed = Feed(spark, str(tmp_path / "in"), "channel_idx int, value double")
    values = [[(0, 1.0), (1, None), (0, float("nan"))], [(0, 4.0), (1, 2.0)], [(0, 10.0), (1, 6.0), (1, 6.5)]]
    for rows in values:
        feed.add(rows)
    parts, progress = str(tmp_path / "parts"), str(tmp_path / "progress")
    whole = ss.channel_stats
    calls = []

    def failing(batch, keys, value):
        calls.append(len(calls))
        out = whole(batch, keys, value)
        if calls[-1] == 1:  # stored, but the batch is not finished
            out.write.mode("overwrite").parquet(f"{parts}/batch=1")
        if calls[-1] in (1, 2):
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(ss, "channel_stats", failing)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            ss.keep_partial_stats(feed.stream(), parts, progress).trigger(availableNow=True).start().awaitTermination()
    ss.keep_partial_stats(feed.stream(), parts, progress).trigger(availableNow=True).start().awaitTermination()
    got = {r.channel_idx: (r.n, r.mean, r.std, r.n_null) for r in ss.stored_stats(spark, parts).collect()}
    rows = spark.createDataFrame([r for part in values for r in part], feed.schema)
    want = {r.channel_idx: (r.n, r.mean, r.std, r.n_null) for r in st.channel_stats(rows).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
