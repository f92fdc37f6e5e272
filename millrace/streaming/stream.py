"""Streams: runs are compacted as they end, by the batch plan; savings are summed by day."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans import compact as plan
from ..plans.config import Config

LINES = "run_id bigint, line_no bigint, text string, ts timestamp, end boolean"
_OUT = "run_id bigint, line_no bigint, text string, late boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = 10_000


class OpenRuns(StatefulProcessor):
    """Keeps a run's lines until its end row comes, or no line has for ``idle``; then gives them all.

    A timer stands for each run: while it is open, at its last line plus ``idle``; afterwards at the time when the
    run may be forgotten. Lines that come in between are late: they are given at once, marked so. A batch reads
    and writes the state of the runs that it has lines of, and of those whose timer is due, and of no others.
    """

    def __init__(self, idle: timedelta, remember: timedelta):
        self.idle, self.remember = int(idle.total_seconds() * 1000), int(remember.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line_no bigint, text string")
        self.state = handle.getValueState("state", "over boolean, due bigint")  # the time of the timer, in ms

    def _wake(self, over: bool, due: int) -> None:
        if self.state.exists():
            self.handle.deleteTimer(self.state.get()[1])
        self.handle.registerTimer(due)
        self.state.update((over, due))

    def _released(self, run_id: int, now: int) -> Iterator[pd.DataFrame]:
        part: list[tuple] = []
        for line_no, text in self.lines.get() if self.lines.exists() else ():
            part.append((run_id, line_no, text, False))
            if len(part) == _ROWS:
                yield self._frame(part)
                part = []
        yield self._frame(part)
        self.lines.clear()
        self._wake(True, now + self.remember)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["run_id", "line_no", "text", "late"])
        return out.astype({"run_id": "int64", "line_no": "int64", "late": "bool"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        over = self.state.exists() and self.state.get()[0]
        newest, ended = 0, False
        for pdf in rows:
            newest = max(newest, int(pdf["clock"].max().timestamp() * 1000))
            ended = ended or bool(pdf["end"].any())
            own = pdf[pdf["line_no"].notna()]
            fresh = list(zip(own["line_no"].astype("int64").tolist(), own["text"].tolist(), strict=True))
            if over:
                yield self._frame([(key[0], n, t, True) for n, t in fresh])
            elif fresh:
                self.lines.appendList(fresh)
        if over:
            return
        newest = max(newest, timerValues.getCurrentWatermarkInMs())
        if ended:
            yield from self._released(key[0], newest)
        else:
            self._wake(False, newest + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over, due = self.state.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        if over:
            self.state.clear()  # forgotten: a line that comes now opens a run of its own
        else:
            yield from self._released(key[0], due)

    def close(self) -> None:
        pass


def ended_runs(
    lines: DataFrame, idle: timedelta = timedelta(minutes=10), delay: timedelta = timedelta(minutes=1), remember: timedelta = timedelta(days=1), clock: str | None = None
) -> DataFrame:
    """(run_id, line_no, text, late) of a stream of ``LINES``: all lines of a run in the batch in which it is
    released, and late lines as they come.

    A run is released when its end row comes, or when the stream's time has passed its last line by ``idle`` (it was
    killed). Lines may come in any order inside a run. clock: the column that tells the time. By default it is the
    time of arrival, and no line can be too old; with a column of their own, lines more than ``delay`` behind the
    newest one of all runs are dropped by Spark. A run is remembered for ``remember`` after its release.
    """
    when = F.current_timestamp() if clock is None else F.col(clock)
    rows = lines.select("run_id", "line_no", "text", F.coalesce("end", F.lit(False)).alias("end"), when.alias("clock"))
    rows = rows.withWatermark("clock", f"{int(delay.total_seconds() * 1000)} milliseconds")
    return rows.groupBy("run_id").transformWithStateInPandas(OpenRuns(idle, remember), _OUT, "append", "eventTime")


def compact_stream(
    spark: SparkSession, lines: DataFrame, runs: DataFrame, late: str, emit: Callable[[DataFrame, DataFrame, DataFrame, int], None], cfg: Config = Config(),
    idle: timedelta = timedelta(minutes=10), delay: timedelta = timedelta(minutes=1), remember: timedelta = timedelta(days=1), clock: str | None = None, checkpoint: str | None = None,
) -> StreamingQuery:
    """Runs are compacted by the batch plan in the batch in which they are released (see ``ended_runs``).

    emit: takes the kept lines, the elided ones, the figures and the number of the batch; a batch that failed comes
    again with its number, so sinks that write by number (``append_ledger(batch=...)``) hold nothing twice. Late lines
    go to the folder ``late``, by batch as well. An open run is held in the state store, which is on disk; nothing of
    it is given before it ends, because only then is it known whether its filtered form is the smaller one.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        ready = batch.where("NOT late").drop("late")
        if ready.take(1):
            emit(*plan.compact(ready, runs, cfg), number)
        batch.unpersist()

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # what keeps lists and timers; read when the query starts
    try:
        writer = ended_runs(lines, idle, delay, remember, clock).writeStream.outputMode("append").foreachBatch(one)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def stream_savings(ledger: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """T4: the ledger's totals by window of time, as a streaming aggregate."""
    g = ledger.withWatermark("time", delay).groupBy(F.window("time", window).alias("w"))
    g = g.agg(F.count("*").alias("runs"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("out_bytes").alias("out_bytes"))
    return g.select(F.col("w.start").alias("start"), "runs", "raw_bytes", "out_bytes", F.greatest(F.lit(0), F.col("raw_bytes") - F.col("out_bytes")).alias("saved"))
