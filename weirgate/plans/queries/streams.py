"""Streaming jobs run to the end of their present input; each returns the table it leaves behind."""

from pyspark.sql import functions as F

from weirgate.plans.queries.events import RESHAPED, STAMP, raw_events, stamp
from weirgate.plans.queries.lineage import lifecycle_sql
from weirgate.plans.registry import query
from weirgate.session import path_bytes, scratch_path
from weirgate.streaming import ingest, lifecycle, windows
from weirgate.streaming.state import stateful_session


def folders(t, label):
    base = scratch_path(t.spark, label)
    return f"{base}/out", f"{base}/checkpoint"


def event_stream(t):
    return ingest.file_stream(t.spark, t.path("events"), t.events.schema)


def stateful_event_stream(t):
    path = t.path("events")
    return ingest.file_stream(stateful_session(t.spark, path_bytes(t.spark, path)), path, t.events.schema)


@query(
    "T1",
    f"""SELECT event_id, user_id, event_type, ts AS "timestamp", CAST(NULL AS VARCHAR) AS session,
               CASE WHEN event_type = 'view' THEN '{{}}'
                    ELSE concat('{{"k":', regexp_extract(props, '([0-9]+)', 1), '}}') END AS properties,
               TIMESTAMP '{STAMP}' AS processed_at, '2024-02-01' AS date FROM events""",
)
def stream_ingest(t):
    out, checkpoint = folders(t, "ingest")
    ingest.run_available(ingest.ingest_events(raw_events(event_stream(t)), RESHAPED, out, checkpoint, stamp()))
    return t.spark.read.parquet(out).withColumn("date", F.col("date").cast("string"))


@query("T2", "SELECT date_trunc('minute', ts) AS window_start, user_id, count(*) AS events FROM events GROUP BY 1, 2")
def stream_user_counts(t):
    out, checkpoint = folders(t, "counts")
    ingest.run_available(windows.save_updates(windows.user_counts(stateful_event_stream(t)), out, checkpoint))
    return windows.latest_updates(t.spark, out, ["window_start", "user_id"])


@query("T2", "SELECT date_trunc('minute', ts) AS window_start, user_id, count(*) AS events FROM events GROUP BY 1, 2")
def batch_user_counts(t):
    return windows.user_counts(t.events)


@query("T4", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus")
def stream_on_change(t):
    out, checkpoint = folders(t, "change")
    orders = t.orders

    def run(batch):
        batch.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")).write.mode("append").parquet(out)

    first = ingest.on_change(t.spark, t.path("orders"), orders.schema, checkpoint, run)
    second = ingest.on_change(t.spark, t.path("orders"), orders.schema, checkpoint, run)
    assert first == 1 and second == 0, (first, second)
    return t.spark.read.parquet(out).groupBy("o_orderstatus").agg(F.sum("orders").alias("orders"))


@query(
    "T5",
    """SELECT event_type, window_start, count(*) AS total, count(*) / CAST(300 AS DOUBLE) AS per_second
       FROM (SELECT event_type, date_trunc('minute', ts) - unnest([0, 1, 2, 3, 4]) * INTERVAL '1' MINUTE AS window_start FROM events)
       GROUP BY event_type, window_start""",
)
def stream_rates(t):
    out, checkpoint = folders(t, "rates")
    ingest.run_available(windows.save_updates(windows.sliding_rates(stateful_event_stream(t), "event_type"), out, checkpoint))
    return windows.latest_updates(t.spark, out, ["window_start", "event_type"])


@query("T6", lifecycle_sql("(SELECT max(event_time) - INTERVAL '10' MINUTE FROM lineage_events)"))
def stream_lifecycle(t):
    """The batch form as of the last watermark. The stream stops half way through and goes on from its checkpoint."""
    out, checkpoint = folders(t, "lifecycle")
    source = scratch_path(t.spark, "lineage")
    events, half = t.lineage_events, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    for later in (False, True):
        events.where((F.col("event_time") >= half) == F.lit(later)).write.mode("append").parquet(source)
        stream = ingest.file_stream(stateful_session(t.spark), source, events.schema)
        ingest.run_available(windows.save_updates(lifecycle.lifecycle_stream(stream, timeout_seconds=3600), out, checkpoint))
    return windows.latest_updates(t.spark, out, ["run_id", "job_name"])


@query("T7", "SELECT event_id, user_id, event_type, user_name, user_email FROM events LEFT JOIN users USING (user_id)")
def stream_enrichment(t):
    out, checkpoint = folders(t, "enrich")
    ingest.run_available(ingest.enrich_stream(event_stream(t), lambda: t.users, out, checkpoint))
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type", "user_name", "user_email")


@query("T9", "SELECT events.*, place FROM events CROSS JOIN (VALUES ('lake'), ('mirror')) AS p(place)")
def stream_fan_out(t):
    out, checkpoint = folders(t, "fan")
    places = {name: f"{out}/{name}" for name in ("lake", "mirror")}
    ingest.run_available(ingest.fan_out_stream(event_stream(t), places, checkpoint))
    found = [t.spark.read.parquet(path).drop("batch_id").withColumn("place", F.lit(name)) for name, path in places.items()]
    return found[0].unionByName(found[1])


@query("T10", "SELECT event_id, event_type, value * 0.5 AS score FROM events")
def stream_scores(t):
    out, checkpoint = folders(t, "score")
    stream = event_stream(t).select("event_id", "event_type", "value")
    ingest.run_available(ingest.score_stream(stream, lambda x: x["value"] * 0.5, ["value"], out, checkpoint))
    return t.spark.read.parquet(out).select("event_id", "event_type", "score")


@query("T3", "SELECT 'RUNNING' AS event_type, count(*) AS records_processed FROM events")
def stream_heartbeats(t):
    """The heartbeats of a query over all events, read back from where the listener's rows were appended."""
    out, checkpoint = folders(t, "beats")
    log = lifecycle.BeatLog(t.spark, f"{out}-log")
    listener = lifecycle.HeartbeatListener(log)
    t.spark.streams.addListener(listener)
    try:
        query = ingest.run_available(ingest.fan_out_stream(event_stream(t), {"lake": out}, checkpoint))
        if not listener.wait_for_end(str(query.runId), seconds=300):
            raise RuntimeError("the stream's last heartbeat did not arrive")
    finally:
        t.spark.streams.removeListener(listener)
        log.close()
    beats = t.spark.read.schema(lifecycle.BEAT).parquet(f"{out}-log").filter(F.col("run_id") == str(query.runId))
    return beats.groupBy("event_type").agg(F.max("records_processed").alias("records_processed"))


@query(
    "T3 F7",
    """WITH beats AS (SELECT DISTINCT run_id, event_time FROM heartbeats),
            steps AS (SELECT *, lead(event_time) OVER (PARTITION BY run_id ORDER BY event_time) AS next_time FROM beats)
       SELECT run_id, event_time, event_time + INTERVAL '2' HOUR AS missed_at FROM steps
       WHERE coalesce(next_time, (SELECT max(event_time) - INTERVAL '10' MINUTE FROM beats)) > event_time + INTERVAL '2' HOUR""",
)
def stream_missed_beats(t):
    """The stream stops half way through and goes on from its checkpoint."""
    out, checkpoint = folders(t, "missed")
    source = scratch_path(t.spark, "heartbeats")
    beats, half = t.heartbeats, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    for later in (False, True):
        beats.where((F.col("event_time") >= half) == F.lit(later)).write.mode("append").parquet(source)
        missed = lifecycle.missed_beats(ingest.file_stream(stateful_session(t.spark), source, beats.schema), 3600)
        ingest.run_available(missed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    return t.spark.read.schema(missed.schema).parquet(out)
