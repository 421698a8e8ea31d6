"""Assembling samples from units that arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = T.StructType(
    [
        T.StructField("ts_ms", T.LongType()),
        T.StructField("arrived", T.LongType()),
        T.StructField("complete", T.BooleanType()),
    ]
)


class _Assembler(StatefulProcessor):
    """State of one sample: the units seen, and whether it was already emitted."""

    def __init__(self, expected: int):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        unit = T.StructType([T.StructField("unit", T.StringType())])
        mark = T.StructType([T.StructField("seen", T.BooleanType())])
        tally = T.StructType([T.StructField("n", T.LongType()), T.StructField("done", T.BooleanType())])
        self.units = handle.getMapState("units", unit, mark)
        self.tally = handle.getValueState("tally", tally)

    def _row(self, key, arrived: int, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"ts_ms": [int(key[0])], "arrived": [arrived], "complete": [complete]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.tally.exists():
            n, done = self.tally.get()
        else:
            n, done = 0, False
            self.handle.registerTimer(int(key[0]))  # the watermark already lags by the timeout
        for pdf in rows:
            for unit in pdf["unit"].unique():
                if not self.units.containsKey((unit,)):
                    self.units.updateValue((unit,), (True,))
                    n += 1
        if not done and n >= self.expected:
            done = True
            yield self._row(key, n, True)
        self.tally.update((n, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, done = self.tally.get()
        if not done:
            yield self._row(key, n, False)
        self.units.clear()
        self.tally.clear()

    def close(self) -> None:
        pass


def _without_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop_duplicates()


def assemble_stream(units: DataFrame, expected: int, timeout_hours: int, watermark: str = "1 hour") -> DataFrame:
    """Emit each sample once, as soon as all its units arrived.

    ``units`` has (ts TIMESTAMP, unit STRING).  Units may come in any order and more
    than once.  The watermark lags by the timeout and, for disorder, by ``watermark``: a
    sample that is still short when newer units are that far ahead of it is emitted as
    incomplete, and only units later than that are dropped.

    Copies are thinned out batch by batch before the shuffle, so many copies of one
    sample do not all reach one task.  State holds each unit name once, so it is bounded
    by ``expected`` per open sample.  Needs the RocksDB state store (``STATE_STORE``).
    """
    return (
        units.select("ts", "unit")
        .mapInPandas(_without_copies, "ts timestamp, unit string")
        .withWatermark("ts", f"{watermark} {timeout_hours} hours")
        .withColumn("ts_ms", F.unix_millis("ts"))
        .groupBy("ts_ms")
        .transformWithStateInPandas(
            statefulProcessor=_Assembler(expected),
            outputStructType=OUTPUT,
            outputMode="append",
            timeMode="EventTime",
        )
        .select(F.timestamp_millis("ts_ms").alias("ts"), "arrived", "complete")
    )
