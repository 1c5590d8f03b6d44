"""Windowed counts and rates on streams, kept as a table of updates."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def _event_time(events: DataFrame, delay: str) -> DataFrame:
    """Watermarks need zoned timestamps; without a stream nothing changes."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def user_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Events per user in event-time windows; later than ``delay`` is dropped and counted by Spark.

    The same expression on a batch DataFrame is the reference result.
    """
    source, kind = _event_time(events, delay), events.schema["ts"].dataType
    counted = source.groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w")["start"].cast(kind).alias("window_start"), "user_id", "events")


def sliding_rates(
    events: DataFrame, key: str, delay: str = "10 minutes", window: str = "5 minutes", slide: str = "1 minute",
    seconds: float = 300.0,
) -> DataFrame:
    """Events per second in sliding event-time windows. Copies into windows are combined before the shuffle."""
    source, kind = _event_time(events, delay), events.schema["ts"].dataType
    counted = source.groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("total"))
    return counted.select(
        F.col("w")["start"].cast(kind).alias("window_start"), key, "total", (F.col("total") / F.lit(seconds)).alias("per_second")
    )


def save_updates(result: DataFrame, path: str, checkpoint: str):
    """Write what each batch changed to its own folder; a retried batch replaces its folder.

    Nothing waits for the watermark, so stopping needs no extra flush: the newest row per key is the result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    count_late_rows(result.sparkSession)
    return (
        result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    )


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key among the updates."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("__v")
    return updates.groupBy(*keys).agg(newest).select(*keys, *[F.col("__v")[c].alias(c) for c in values])


class _LateRows(StreamingQueryListener):
    """Adds up, from the start of each query, the rows it drops for being later than its watermark."""

    def __init__(self):
        self._sessions: WeakSet[SparkSession] = WeakSet()
        self._dropped: dict[str, tuple[int, int]] = {}  # by run, the newest batch and the rows dropped up to it
        self._changed = threading.Condition()

    def watch(self, spark: SparkSession) -> None:
        if spark not in self._sessions:
            spark.streams.addListener(self)
            self._sessions.add(spark)

    def total(self, query: StreamingQuery, seconds: float) -> int:
        run = str(query.runId)
        if run not in self._dropped:
            raise LookupError("late rows of this query were not counted from its start: call count_late_rows first")
        last = query.lastProgress
        batch = -1 if last is None else int(last["batchId"])
        with self._changed:
            if not self._changed.wait_for(lambda: self._dropped[run][0] >= batch, timeout=seconds):
                raise TimeoutError(f"batch {batch} was not reported within {seconds} seconds")
            return self._dropped[run][1]

    def onQueryStarted(self, event) -> None:
        self._dropped[str(event.runId)] = (-1, 0)

    def onQueryProgress(self, event) -> None:
        run, batch = str(event.progress.runId), int(event.progress.batchId)
        with self._changed:
            newest, dropped = self._dropped.get(run, (batch, 0))
            if batch > newest:  # one session may have been added twice
                late = sum(int(operator.numRowsDroppedByWatermark) for operator in event.progress.stateOperators)
                self._dropped[run] = (batch, dropped + late)
                self._changed.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


_LATE = _LateRows()


def count_late_rows(spark: SparkSession) -> None:
    """Count the late rows of every query that is started in this session from now on."""
    _LATE.watch(spark)


def late_rows(query: StreamingQuery, seconds: float = 60.0) -> int:
    """Rows a finished or running query has dropped, in all its batches, for being later than its watermark.

    The query has to be started by ``save_updates`` or after ``count_late_rows``; a LookupError says it was not.
    """
    return _LATE.total(query, seconds)
