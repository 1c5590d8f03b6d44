"""Run rows from a stream of lineage events, and heartbeats from running queries."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weirgate.functions.times import millis_between
from weirgate.operators.lineage import END_STATUS

REMEMBERED_ENDS = 1_000
RUN_BUCKETS = 1 << 10
RUN_STATE = "run_id array<string>, job_name array<string>, start array<bigint>, end array<bigint>, status array<string>, due array<bigint>"
RUN_UPDATE = "run_id string, job_name string, start_us bigint, end_us bigint, status string"
ENDS = {event: i for i, event in enumerate(END_STATUS)}
ENDED_AS = {status: event for event, status in END_STATUS.items()}


def _step(run: tuple | None, event: str, at: int) -> tuple:
    """A run (start, end, status, due) after one more event; earliest start, latest end."""
    start, end, status, due = run or (None, None, None, None)
    if event == "START":
        return at if start is None else min(start, at), end, status, due
    if end is None or (at, ENDS[event]) > (end, ENDS[ENDED_AS[status]]):
        return start, at, END_STATUS[event], due
    return run


def follow_runs(timeout_ms: int, keep_ms: int):
    """The function that follows the runs of one bucket: each run's earliest start, latest end, status, and when its
    status or its state is due to go; the bucket's timer is the earliest of these."""

    def timed(run: tuple) -> tuple:
        start, end, status, due = run
        if end is not None:
            return start, end, status, end // 1000 + keep_ms
        return run if status == "stale" else (start, end, "running", start // 1000 + timeout_ms + 1)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = {(run, job): own for run, job, *own in zip(*state.get)} if state.exists else {}
        before, told = {}, {}
        for rows in batches:
            columns = [rows[c].astype(object).where(rows[c].notna(), None) for c in ("run_id", "job_name", "event_type", "event_us")]
            for run, job, event, at in zip(*columns):
                name = (run, job)
                before.setdefault(name, runs.get(name))
                runs[name] = _step(runs.get(name), event, int(at))
        for name, was in before.items():
            runs[name] = now = timed(runs[name])
            if was is None or now != tuple(was):
                told[name] = now
        watermark = state.getCurrentWatermarkMs()
        for name in [name for name, run in runs.items() if run[3] < watermark]:
            start, end, status, due = runs.pop(name)
            if status == "running":  # otherwise kept long enough after its end, or after it went stale
                runs[name] = stale = (start, end, "stale", due + keep_ms)
                told[name] = stale
        if runs:
            state.update((*map(list, zip(*runs)), *map(list, zip(*runs.values()))))
            state.setTimeoutTimestamp(max(min(run[3] for run in runs.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if told:
            changes = [(*name, *run[:3]) for name, run in told.items()]
            yield pd.DataFrame(changes, columns=["run_id", "job_name", "start_us", "end_us", "status"]).astype({"start_us": "Int64", "end_us": "Int64"})

    return follow


def lifecycle_stream(
    events: DataFrame, timeout_seconds: int = 3600, delay: str = "10 minutes", keep_seconds: int = 86_400, buckets: int = RUN_BUCKETS
) -> DataFrame:
    """Changes of runs from a stream of (run_id, event_type, event_time, job_name); the newest per run is its row.

    The columns are those of :func:`weirgate.operators.lineage.run_lifecycle`. A run is emitted when it opens, when
    it ends, and as stale when the watermark has passed its start by the timeout without an end. Its state goes
    ``keep_seconds`` after its end, or after it went stale; an end that comes before that still closes a stale
    run. The source is read once and its rows are kept in one state. Heartbeats never reach the shuffle, and
    repeated events of a run change nothing. Events later than the watermark or without a time are dropped. Start it
    in update mode in a session of :func:`weirgate.streaming.state.stateful_session`, for instance with ``save_updates``.

    Runs are dealt by hash to ``buckets``, which share one value of state and one event-time timer each, so Python is
    called once for a bucket and batch and not several times for a run. A checkpoint keeps the number it began with.
    """
    kind = events.schema["event_time"].dataType
    steps = (
        events.filter(F.col("event_type").isin("START", *END_STATUS) & F.col("event_time").isNotNull())
        .select("run_id", "job_name", "event_type", F.col("event_time").cast("timestamp").alias("event_time"))
        .withWatermark("event_time", delay)
        .withColumn("event_us", F.unix_micros("event_time"))
        .withColumn("bucket", F.pmod(F.xxhash64("run_id", "job_name"), F.lit(buckets)))
    )
    follow = follow_runs(timeout_seconds * 1000, keep_seconds * 1000)
    changes = steps.groupBy("bucket").applyInPandasWithState(follow, RUN_UPDATE, RUN_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    start, end = (F.timestamp_micros(c).cast(kind) for c in ("start_us", "end_us"))
    timed = changes.select("run_id", "job_name", start.alias("start_time"), end.alias("end_time"), "status")
    return timed.withColumn("duration_ms", millis_between(F.col("start_time"), F.col("end_time")))


BEAT = "run_id string, event_type string, event_time timestamp, uptime_seconds double, records_processed bigint"
MISS = "run_id string, last_us bigint, missed_us bigint"


class LivenessProcessor(StatefulProcessor):
    """One run's newest heartbeat, with a timer for when the next one is late."""

    def __init__(self, allowed_us: int):
        self.allowed_us = allowed_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "last bigint, due bigint")

    def _missed(self, key, last: int) -> Row:
        return Row(run_id=key[0], last_us=last, missed_us=last + self.allowed_us)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, due = self.beat.get() or (None, None)
        before, told = due, last is not None and due is None  # without a timer the newest beat's miss is told
        for at in sorted({r["event_us"] for r in rows}):
            if last is not None and at <= last:
                continue
            if last is not None and at - last > self.allowed_us and not told:
                yield self._missed(key, last)
            last, told = at, False
            due = (last + self.allowed_us) // 1000 + 1
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.beat.update((last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, _ = self.beat.get()
        self.beat.update((last, None))
        yield self._missed(key, last)

    def close(self) -> None:
        pass


def missed_beats(beats: DataFrame, interval_seconds: int, allowed: float = 2.0, delay: str = "10 minutes") -> DataFrame:
    """A row (run_id, event_time, missed_at) for each heartbeat that no other follows within ``allowed`` intervals.

    From a stream of (run_id, event_time). The newest beat of a run is reported by an event-time timer, once the
    watermark has passed the time the next one was due, without waiting for another beat. Equal beats are one.
    """
    kind = beats.schema["event_time"].dataType
    steps = (
        beats.select("run_id", F.col("event_time").cast("timestamp").alias("event_time"))
        .withWatermark("event_time", delay)
        .withColumn("event_us", F.unix_micros("event_time"))
    )
    processor = LivenessProcessor(int(interval_seconds * allowed * 1_000_000))
    missed = steps.groupBy("run_id").transformWithState(processor, MISS, "append", "EventTime")
    return missed.select(
        "run_id", F.timestamp_micros("last_us").cast(kind).alias("event_time"), F.timestamp_micros("missed_us").cast(kind).alias("missed_at")
    )


class BeatLog:
    """Heartbeats appended to a folder as rows, by a thread of their own and in the batches that pile up meanwhile.

    Pass it to a :class:`HeartbeatListener`. A batch that fails is kept and tried again with the next one; ``close``
    writes what is left and raises what went wrong last, if anything is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._waiting: list[tuple] = []
        self._error: Exception | None = None
        self._closed = False
        self._changed = threading.Condition()
        self._thread = threading.Thread(target=inheritable_thread_target(spark)(self._run), daemon=True)
        self._thread.start()

    def __call__(self, beat: dict) -> None:
        with self._changed:
            self._waiting.append(tuple(beat[name] for name in ("run_id", "event_type", "event_time", "uptime_seconds", "records_processed")))
            self._changed.notify()

    def _run(self) -> None:
        while True:
            with self._changed:
                self._changed.wait_for(lambda: self._waiting or self._closed)
                batch, self._waiting = self._waiting, []
                if not batch:
                    return
            try:
                self.spark.createDataFrame(batch, BEAT).coalesce(1).write.mode("append").parquet(self.path)
                self._error = None
            except Exception as error:
                with self._changed:
                    self._error, self._waiting = error, batch + self._waiting
                    if self._closed:
                        return
                    self._changed.wait(1.0)

    def close(self) -> None:
        with self._changed:
            self._closed = True
            self._changed.notify()
        self._thread.join()
        if self._error:
            raise self._error


class HeartbeatListener(StreamingQueryListener):
    """Reports a RUNNING event for every progress of a query, and nothing it does can fail the query.

    ``emit`` receives (run_id, event_time, uptime_seconds, records_processed).
    """

    def __init__(self, emit: Callable[[dict], None]):
        self._emit = emit
        self._started: dict[str, datetime] = {}
        self._records: dict[str, int] = {}
        self._ended: dict[str, None] = {}  # in order, the oldest ones are forgotten
        self._changed = threading.Condition()

    def wait_for_end(self, run_id: str, seconds: float) -> bool:
        """Wait until the end of a query, and so all its heartbeats, have been reported."""
        with self._changed:
            return self._changed.wait_for(lambda: run_id in self._ended, timeout=seconds)

    def onQueryStarted(self, event) -> None:
        self._started[str(event.runId)] = datetime.now(timezone.utc)

    def onQueryProgress(self, event) -> None:
        try:
            run = str(event.progress.runId)
            now = datetime.now(timezone.utc)
            self._records[run] = self._records.get(run, 0) + int(event.progress.numInputRows)
            self._emit(
                {
                    "run_id": run,
                    "event_type": "RUNNING",
                    "event_time": now,
                    "uptime_seconds": (now - self._started.get(run, now)).total_seconds(),
                    "records_processed": self._records[run],
                }
            )
        except Exception:
            pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._started.pop(str(event.runId), None)
        self._records.pop(str(event.runId), None)
        with self._changed:
            self._ended[str(event.runId)] = None
            while len(self._ended) > REMEMBERED_ENDS:
                self._ended.pop(next(iter(self._ended)))
            self._changed.notify_all()
