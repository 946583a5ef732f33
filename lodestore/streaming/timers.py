"""Operators that act when nothing happens: timers in state, by event time or by the clock.

A key's events make a burst for as long as none is more than a quiet period after the one before.
Its state is three numbers and its timer; the timer is set anew by each micro-batch that has events
of the key and fires once the watermark, or the clock, has passed the quiet period. Then the burst
is emitted and the state goes. Debounced reprocessing and notices of inactivity are both this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestore.session import python_path
from lodestore.streaming.streams import ROCKSDB


class _Bursts(StatefulProcessor):
    def __init__(self, key: str, quiet_ms: int, by_clock: bool) -> None:
        self.key, self.quiet, self.by_clock = key, quiet_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "first long, last long, n long, timer long")

    def _rows(self, key, bursts: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(bursts), "first_ms": [b[0] for b in bursts], "last_ms": [b[1] for b in bursts], "n": [b[2] for b in bursts]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [r["event_ms"].to_numpy(np.int64) for r in rows if len(r)]
        if not parts:  # a batch without events, for timers alone
            return
        times = np.sort(np.concatenate(parts))  # eight bytes an event
        timer = None
        if self.burst.exists():
            first, last, n, timer = self.burst.get()
        cuts = np.flatnonzero(np.diff(times) > self.quiet) + 1
        ends = [*cuts.tolist(), len(times)]
        bursts = [(int(times[a]), int(times[b - 1]), b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if timer is not None:
            self.handle.deleteTimer(timer)
            merged: list[tuple[int, int, int]] = []
            for one in sorted([*bursts, (first, last, n)]):  # what came out of order joins the bursts it touches
                if merged and one[0] - merged[-1][1] <= self.quiet:
                    before = merged.pop()
                    one = (before[0], max(before[1], one[1]), before[2] + one[2])
                merged.append(one)
            bursts = merged
        first, last, n = bursts.pop()
        timer = (timerValues.getCurrentProcessingTimeInMs() if self.by_clock else last) + self.quiet
        self.handle.registerTimer(timer)
        self.burst.update((first, last, n, timer))
        if bursts:  # a later event has ended these
            yield self._rows(key, bursts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.burst.exists():
            first, last, n, _ = self.burst.get()
            self.burst.clear()
            yield self._rows(key, [(first, last, n)])

    def close(self) -> None:
        pass


def bursts(events: DataFrame, key: str, quiet_seconds: float, late: str = "10 minutes", ts: str = "ts", by_clock: bool = False) -> DataFrame:
    """(key, first_ms, last_ms, n) of each burst of a stream, once it is over.

    By event time a burst is over when the watermark, ``late`` behind the latest event, has passed
    the quiet period after its last event, or a later event of the key shows it; later rows are
    dropped. ``by_clock`` it is over when the clock has. Rows without a time are passed over; null
    keys are one key. Bursts that are open when a stream stops stay in its checkpoint. By the clock a
    query has always something to wait for: run it with a processing-time trigger, not over what is there.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    python_path(spark)
    e = events.select(key, F.col(ts).cast("timestamp").alias("event_time")).filter("event_time IS NOT NULL").withColumn("event_ms", F.unix_millis("event_time"))
    e = e if by_clock else e.withWatermark("event_time", late)
    kind = dict(events.select(key).dtypes)[key]
    processor = _Bursts(key, int(quiet_seconds * 1000), by_clock)
    return e.groupBy(key).transformWithStateInPandas(processor, outputStructType=f"`{key}` {kind}, first_ms long, last_ms long, n long", outputMode="Append", timeMode="ProcessingTime" if by_clock else "EventTime")
