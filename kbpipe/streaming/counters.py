"""Alerts and counters with keyed state: ``transformWithState`` jobs.

Raw events never reach the state: every Arrow batch is first counted per key
and minute inside its own partition, so a minute or an event type with a third
of all events is a few rows per task. State is held per day of windows (alarms)
or per counter, event-time timers end it, and what is still open when a stream
stops is read from its state store, so nothing waits for later events.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kbpipe.operators.metrics import REQUEST_ALERT_THRESHOLD, fmt_ts

WATERMARK = "5 minutes"
MINUTE_MS, DAY_MS = 60_000, 86_400_000
WINDOW_MINUTES, SLIDE_MINUTES = 5, 1      # the request alert's window and evaluation period
_STATE = {"spark.sql.streaming.stateStore.providerClass":
          "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextlib.contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None):
    """Queries started inside use the state store that keyed state needs, in
    ``partitions`` parts if given (a stream keeps those of its first start);
    the session's own settings are back afterwards."""
    conf = _STATE | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def minute_counts(events: DataFrame, key: str | None = None, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """``key, minute, n, last``: events of a partition's batch per key and
    minute (epoch milliseconds), with the newest event time. Narrow: the
    counts of several tasks meet in the state. Rows without a time are no
    events, a NULL key is a key of its own."""
    rows = events.where(F.col(ts).isNotNull()).select(
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = batch.column("ms").to_numpy()
            t = pa.table({"key": batch.column("key"), "minute": ms // MINUTE_MS * MINUTE_MS, "ms": ms})
            g = t.group_by(["key", "minute"]).aggregate([("ms", "count"), ("ms", "max")])
            last = pc.cast(pc.multiply(g["ms_max"], 1000), pa.timestamp("us", "UTC"))
            yield from pa.table({"key": g["key"], "minute": g["minute"], "n": g["ms_count"], "last": last}).to_batches()

    return rows.mapInArrow(run, "key string, minute bigint, n bigint, last timestamp").withWatermark("last", watermark)


class _Open(StatefulProcessor):
    """Base: one state value with the open spans of a key as sorted arrays
    (start, count, ...), read and written once per call, and one timer at a
    time, at the end of the earliest open span."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def _wait(self, starts: np.ndarray) -> None:
        if len(starts):
            self.handle.registerTimer(int(starts[0]) + self.span_ms)

    def _merged(self, starts, counts, rows: Iterator[pd.DataFrame], of: str):
        """(starts, counts) after the batch's partial counts."""
        new = [(r[of].to_numpy(np.int64), r["n"].to_numpy(np.int64)) for r in rows]
        at = np.concatenate([np.array(starts, np.int64), *(x for x, _ in new)])
        n = np.concatenate([np.array(counts, np.int64), *(x for _, x in new)])
        at, where = np.unique(at, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, where, n)
        return at, total

    def _due(self, starts: np.ndarray, timerValues) -> int:
        """Number of spans that the watermark has passed."""
        return int(np.searchsorted(starts + self.span_ms, timerValues.getCurrentWatermarkInMs(), side="right"))

    def close(self) -> None:
        pass


class _Alarm(_Open):
    """State of the sliding windows that start on one day: counts, and which
    have been raised."""

    def __init__(self, threshold: int, window_ms: int):
        super().__init__(window_ms)
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getValueState("panes", "starts array<bigint>, counts array<bigint>, raised array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, counts, raised = self.panes.get() if self.panes.exists() else ([], [], [])
        starts, n = self._merged(old, counts, rows, "start")
        reached = starts[n >= self.threshold]
        now = np.setdiff1d(reached, np.array(raised, np.int64))
        if len(now):
            yield self._rows(now, n[np.searchsorted(starts, now)], "raised")
        if not len(old):
            self._wait(starts)
        elif starts[0] < old[0]:
            self.handle.deleteTimer(int(old[0]) + self.span_ms)
            self._wait(starts)
        self.panes.update((starts.tolist(), n.tolist(), reached.tolist()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        starts, n, raised = (np.array(x, np.int64) for x in self.panes.get())
        due = self._due(starts, timerValues)
        gone = np.isin(starts[:due], raised)
        if gone.any():
            yield self._rows(starts[:due][gone], n[:due][gone], "closed")
        if due < len(starts):
            self.panes.update((starts[due:].tolist(), n[due:].tolist(), np.intersect1d(raised, starts[due:]).tolist()))
            self._wait(starts[due:])
        else:
            self.panes.clear()

    @staticmethod
    def _rows(starts, n, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"start": starts, "n_requests": n, "kind": kind})


def _named(windows: DataFrame, window_minutes: int) -> DataFrame:
    end = F.timestamp_millis(F.col("start") + window_minutes * MINUTE_MS)
    return windows.select(fmt_ts(F.timestamp_millis("start")).alias("window_start"), fmt_ts(end).alias("window_end"),
                          "n_requests", "kind")


def request_alarms(events: DataFrame, threshold: int = REQUEST_ALERT_THRESHOLD, window_minutes: int = WINDOW_MINUTES,
                   slide_minutes: int = SLIDE_MINUTES, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """``window_start, window_end, n_requests, kind`` of a stream of events.

    A window is ``raised`` once, in the micro-batch that brings its count to
    the threshold (with the count known then), and ``closed`` with its final
    count when the watermark passes its end."""
    slide = slide_minutes * MINUTE_MS
    counts = minute_counts(events, ts=ts, watermark=watermark)
    last_start = F.col("minute") - F.pmod("minute", F.lit(slide))
    panes = counts.withColumn("start", F.explode(F.sequence(
        last_start - (window_minutes * MINUTE_MS - slide), last_start, F.lit(slide))))
    out = panes.withColumn("day", F.floor(F.col("start") / DAY_MS)).groupBy("day").transformWithStateInPandas(
        _Alarm(threshold, window_minutes * MINUTE_MS), "start bigint, n_requests bigint, kind string", "append", "eventtime")
    return _named(out, window_minutes)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def open_alarms(spark: SparkSession, checkpoint: str, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Raised windows that a stopped alarm stream has not closed yet, with
    their counts so far."""
    panes = _state(spark, checkpoint, "panes").select("value.raised", F.explode(
        F.arrays_zip("value.starts", "value.counts")).alias("p"))
    return _named(panes.where(F.array_contains("raised", F.col("p.starts"))).select(
        F.col("p.starts").alias("start"), F.col("p.counts").alias("n_requests"), F.lit("open").alias("kind")), window_minutes)


class _Counter(_Open):
    """State of one counter: its value at the last export, and the counts of
    the periods that are still open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "total bigint, starts array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, old, counts = self.counter.get() if self.counter.exists() else (0, [], [])
        rows = (r.assign(start=r["minute"] // self.span_ms * self.span_ms) for r in rows)
        starts, n = self._merged(old, counts, rows, "start")
        if not len(old):
            self._wait(starts)
        elif starts[0] < old[0]:
            self.handle.deleteTimer(int(old[0]) + self.span_ms)
            self._wait(starts)
        self.counter.update((int(total), starts.tolist(), n.tolist()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, starts, n = self.counter.get()
        starts, n = np.array(starts, np.int64), np.array(n, np.int64)
        due = self._due(starts, timerValues)
        value = int(total) + np.cumsum(n[:due])
        if due:
            yield pd.DataFrame({"key": [key[0]] * due, "at": starts[:due] + self.span_ms, "n_events": n[:due],
                                "cumulative": value})
            total = int(value[-1])
        self.counter.update((int(total), starts[due:].tolist(), n[due:].tolist()))
        self._wait(starts[due:])


def counter_exports(events: DataFrame, key: str = "event_type", period_minutes: int = 1, ts: str = "ts",
                    watermark: str = WATERMARK) -> DataFrame:
    """``key, exported_at, n_events, cumulative`` of a stream of events: at the
    end of every period with events (once the watermark has passed it) the
    counter's value, which the state carries over restarts."""
    counts = minute_counts(events, key, ts, watermark)
    out = counts.groupBy("key").transformWithStateInPandas(
        _Counter(period_minutes * MINUTE_MS), "key string, at bigint, n_events bigint, cumulative bigint",
        "append", "eventtime")
    return out.select(F.col("key").alias(key), fmt_ts(F.timestamp_millis("at")).alias("exported_at"), "n_events",
                      "cumulative")


def open_counters(spark: SparkSession, checkpoint: str, key: str = "event_type", period_minutes: int = 1) -> DataFrame:
    """The periods that a stopped counter stream has not exported yet, as they
    would be exported next."""
    rest = _state(spark, checkpoint, "counter").select(F.col("key.key").alias("k"), "value.total", F.explode(
        F.arrays_zip("value.starts", "value.counts")).alias("p"))
    run = Window.partitionBy("k").orderBy("p.starts").rowsBetween(Window.unboundedPreceding, 0)
    return rest.select(
        F.col("k").alias(key), fmt_ts(F.timestamp_millis(F.col("p.starts") + period_minutes * MINUTE_MS)).alias("exported_at"),
        F.col("p.counts").alias("n_events"), (F.sum("p.counts").over(run) + F.col("total")).alias("cumulative"))


def start_append(stream: DataFrame, sink_dir: str, checkpoint: str, available_now: bool = True,
                 state_partitions: int | None = None):
    """Rows of a keyed-state stream appended as parquet under ``sink_dir``.
    Every state partition runs a Python worker per micro-batch: a few suffice
    for the counts of a stream, however many events it has."""
    w = (stream.writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    with keyed_state(stream.sparkSession, state_partitions):
        return w.start()
