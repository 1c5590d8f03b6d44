import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weirgate.streaming import ingest, lifecycle, windows
from weirgate.session import path_bytes, shuffle_partitions, size_shuffles
from weirgate.streaming.state import state_partitions, stateful_session

START = datetime(2024, 1, 1)
EVENTS = "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz"
LINEAGE = "run_id string, event_type string, event_time timestamp_ntz, job_name string"


def land(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def event(i, user, minutes, kind="view"):
    return (i, user, kind, START + timedelta(minutes=minutes))


def schema_of(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_ingest_restarts_without_loss_or_repeats(spark, folder):
    schema = schema_of(spark, EVENTS)
    names = {"event_id": "event_id", "event_type": "event_type", "properties": "props"}

    def run():
        stream = ingest.file_stream(spark, f"{folder}/in", schema, max_files=1)
        stamp = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
        return ingest.run_available(ingest.ingest_events(stream, names, f"{folder}/out", f"{folder}/cp", stamp))

    land(spark, folder, "in", [event(1, 1, 0), event(2, 1, 1)], EVENTS)
    land(spark, folder, "in", [event(3, 1, 2)], EVENTS)
    assert len(run().recentProgress) >= 2
    land(spark, folder, "in", [event(4, 1, 3)], EVENTS)
    run()
    run()
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4]
    assert {str(r.date) for r in out.collect()} == {"2024-05-06"}
    assert out.filter("properties IS NOT NULL").count() == 0


def test_counts_drop_and_count_late_rows(spark, folder):
    schema = schema_of(spark, EVENTS)

    def run():
        counts = windows.user_counts(ingest.file_stream(stateful_session(spark), f"{folder}/in", schema), "10 minutes")
        return ingest.run_available(windows.save_updates(counts, f"{folder}/out", f"{folder}/cp"))

    land(spark, folder, "in", [event(1, 1, 0), event(2, 1, 0.5), event(3, 2, 60)], EVENTS)
    run()
    land(spark, folder, "in", [event(4, 1, 0.2), event(5, 2, 60.5), event(6, 2, 55)], EVENTS)
    late = windows.late_rows(run())
    got = {(r.window_start, r.user_id): r.events for r in windows.latest_updates(spark, f"{folder}/out", ["window_start", "user_id"]).collect()}
    assert got == {
        (START, 1): 2, (START + timedelta(minutes=60), 2): 2, (START + timedelta(minutes=55), 2): 1,
    }
    assert late == 1


def test_late_rows_of_all_batches_are_counted(spark, folder):
    schema = schema_of(spark, EVENTS)
    land(spark, folder, "in", [event(1, 1, 60)], EVENTS)
    land(spark, folder, "in", [event(4, 1, 60)], EVENTS)
    land(spark, folder, "in", [event(2, 1, 0), event(3, 2, 1)], EVENTS)
    rows = spark.sparkContext.parallelize([event(10 + i, 1, 60) for i in range(103)], 103)
    spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(f"{folder}/in")
    session = stateful_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "1")
    counts = windows.user_counts(ingest.file_stream(session, f"{folder}/in", schema, max_files=1), "10 minutes")
    query = ingest.run_available(windows.save_updates(counts, f"{folder}/out", f"{folder}/cp"))
    assert query.lastProgress["batchId"] > 100 >= len(query.recentProgress)
    assert windows.late_rows(query) == 2


def test_late_rows_of_an_unwatched_query_are_not_guessed(spark, folder):
    land(spark, folder, "in", [event(1, 1, 0)], EVENTS)
    session = spark.newSession()
    stream = ingest.file_stream(session, f"{folder}/in", schema_of(spark, EVENTS))
    writer = stream.writeStream.format("noop").option("checkpointLocation", f"{folder}/cp")
    with pytest.raises(LookupError):
        windows.late_rows(ingest.run_available(writer))


def test_on_change_runs_only_for_new_files(spark, folder):
    schema, seen = schema_of(spark, EVENTS), []

    def run():
        return ingest.on_change(spark, f"{folder}/in", schema, f"{folder}/cp", lambda b: seen.append(b.count()))

    land(spark, folder, "in", [event(1, 1, 0)], EVENTS)
    assert run() == 1 and run() == 0
    land(spark, folder, "in", [event(2, 1, 0), event(3, 1, 0)], EVENTS)
    assert run() == 1 and seen == [1, 2]


def test_on_change_repeats_after_a_failure(spark, folder):
    schema = schema_of(spark, EVENTS)
    land(spark, folder, "in", [event(1, 1, 0)], EVENTS)

    def fail(batch):
        raise RuntimeError("no")

    with pytest.raises(Exception):
        ingest.on_change(spark, f"{folder}/in", schema, f"{folder}/cp", fail)
    seen = []
    assert ingest.on_change(spark, f"{folder}/in", schema, f"{folder}/cp", lambda b: seen.append(b.count())) == 1
    assert seen == [1]


def step(run, kind, minutes):
    return (run, kind, START + timedelta(minutes=minutes), "job")


def follow(spark, folder, max_files=None, **kw):
    """The newest rows of all runs, after the files that are there were followed to their end."""
    stream = ingest.file_stream(stateful_session(spark), f"{folder}/in", schema_of(spark, LINEAGE), max_files=max_files)
    rows = lifecycle.lifecycle_stream(stream, 3600, "10 minutes", **kw)
    query = ingest.run_available(windows.save_updates(rows, f"{folder}/out", f"{folder}/cp"))
    newest = windows.latest_updates(spark, f"{folder}/out", ["run_id", "job_name"])
    return query, {r.run_id: (r.status, r.duration_ms) for r in newest.collect()}


def test_lifecycle(spark, folder):
    chatty = [step("r1", "RUNNING", i / 10) for i in range(50)]
    land(spark, folder, "in", [step("r1", "START", 0), step("r1", "START", 0), *chatty, step("r2", "START", 1), step("r3", "START", 2)], LINEAGE)
    assert set(follow(spark, folder)[1].values()) == {("running", None)}
    land(spark, folder, "in", [step("r1", "COMPLETE", 6), step("r1", "COMPLETE", 6), step("r3", "FAIL", 7)], LINEAGE)
    assert follow(spark, folder)[1] == {"r1": ("success", 360_000), "r2": ("running", None), "r3": ("failure", 300_000)}
    land(spark, folder, "in", [step("r4", "START", 200), step("r4", "ABORT", 201)], LINEAGE)
    land(spark, folder, "in", [step("r5", "START", 300)], LINEAGE)
    wanted = {"r1": ("success", 360_000), "r2": ("stale", None), "r3": ("failure", 300_000), "r4": ("cancelled", 60_000), "r5": ("running", None)}
    assert follow(spark, folder, max_files=1)[1] == wanted
    # a late end closes a stale run while its state is kept, a repeated one changes nothing
    land(spark, folder, "in", [step("r2", "COMPLETE", 301), step("r1", "COMPLETE", 302)], LINEAGE)
    wanted |= {"r2": ("success", 18_000_000), "r1": ("success", 302 * 60_000)}
    assert follow(spark, folder)[1] == wanted


def test_lifecycle_state_is_dropped(spark, folder):
    land(spark, folder, "in", [step("r1", "START", 0), step("r1", "FAIL", 1), step("r2", "START", 0)], LINEAGE)
    follow(spark, folder, keep_seconds=600)
    land(spark, folder, "in", [step("r3", "START", 200)], LINEAGE)
    query, _ = follow(spark, folder, keep_seconds=600)
    land(spark, folder, "in", [step("r4", "START", 400)], LINEAGE)
    query, found = follow(spark, folder, keep_seconds=600)
    assert found["r1"][0] == "failure" and found["r2"][0] == found["r3"][0] == "stale" and found["r4"][0] == "running"
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5  # values and timers of r3 and r4


def test_lifecycle_runs_share_buckets(spark, folder):
    """State and timers are by bucket, so Python is not called for each run; every run is still told by itself."""
    opened = [step(f"r{i}", "START", i / 100) for i in range(300)]
    untimed = [("r0", "ABORT", None, "job"), (None, "START", START, None)]
    land(spark, folder, "in", opened + untimed, LINEAGE)
    query, found = follow(spark, folder, buckets=4)
    assert found == {f"r{i}": ("running", None) for i in range(300)} | {None: ("running", None)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    land(spark, folder, "in", [step(f"r{i}", "COMPLETE", 50) for i in range(0, 300, 2)] + [step("last", "START", 100)], LINEAGE)
    _, found = follow(spark, folder, buckets=4)
    assert {found[f"r{i}"][0] for i in range(0, 300, 2)} == {"success"} and {found[f"r{i}"][0] for i in range(1, 300, 2)} == {"stale"}
    assert found[None][0] == "stale" and found["last"][0] == "running" and len(found) == 302


def test_lifecycle_reads_its_source_once(spark, folder):
    land(spark, folder, "in", [step("r1", "START", 0), step("r1", "ABORT", 1)], LINEAGE)
    query, _ = follow(spark, folder)
    assert len(query.lastProgress["sources"]) == 1 and len(query.lastProgress["stateOperators"]) == 1


def test_fan_out_replaces_a_repeated_batch(spark, folder):
    schema = schema_of(spark, EVENTS)
    land(spark, folder, "in", [event(1, 1, 0)], EVENTS)
    paths = {"a": f"{folder}/a", "b": f"{folder}/b"}
    for attempt in ("cp1", "cp2"):
        ingest.run_available(ingest.fan_out_stream(ingest.file_stream(spark, f"{folder}/in", schema), paths, f"{folder}/{attempt}"))
    assert spark.read.parquet(paths["a"]).count() == 1 and spark.read.parquet(paths["b"]).count() == 1


def test_heartbeats_never_fail_the_query(spark, folder):
    schema, beats = schema_of(spark, EVENTS), []
    land(spark, folder, "in", [event(i, 1, 0) for i in range(5)], EVENTS)

    def emit(beat):
        beats.append(beat)
        raise RuntimeError("sink down")

    listener = lifecycle.HeartbeatListener(emit)
    spark.streams.addListener(listener)
    try:
        ingest.on_change(spark, f"{folder}/in", schema, f"{folder}/cp", lambda b: b.count())
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert beats and max(b["records_processed"] for b in beats) >= 5
    assert {b["event_type"] for b in beats} == {"RUNNING"}


def test_beats_are_appended_as_rows_and_failures_tried_again(spark, folder, monkeypatch):
    log = lifecycle.BeatLog(spark, f"{folder}/beats")
    beat = {"event_type": "RUNNING", "event_time": START, "uptime_seconds": 1.5, "records_processed": 7}
    log(beat | {"run_id": "a"})
    log(beat | {"run_id": "b"})
    log.close()
    assert sorted(r.run_id for r in spark.read.parquet(f"{folder}/beats").collect()) == ["a", "b"]
    blocked = lifecycle.BeatLog(spark, f"{folder}/file/beats")
    Path(folder, "file").write_text("in the way")
    blocked(beat | {"run_id": "c"})
    time.sleep(3)
    Path(folder, "file").unlink()
    blocked.close()
    assert [r.run_id for r in spark.read.parquet(f"{folder}/file/beats").collect()] == ["c"]


def test_missed_beats(spark, folder):
    def beat(run, minutes):
        return (run, START + timedelta(minutes=minutes))

    def missed():
        stream = ingest.file_stream(stateful_session(spark), f"{folder}/in", schema_of(spark, BEATS), max_files=1)
        rows = lifecycle.missed_beats(stream, 60, allowed=3)
        ingest.run_available(rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp"))
        return sorted((r.run_id, (r.event_time - START).total_seconds() / 60) for r in spark.read.schema(rows.schema).parquet(f"{folder}/out").collect())

    BEATS = "run_id string, event_time timestamp_ntz"
    land(spark, folder, "in", [beat("a", 0), beat("a", 1), beat("a", 1), beat("a", 5), beat("b", 0), beat("b", 3)], BEATS)
    assert missed() == [("a", 1)]
    land(spark, folder, "in", [beat("a", 6), beat("c", 30)], BEATS)  # the watermark goes to minute 20
    assert missed() == [("a", 1), ("a", 6), ("b", 3)]
    land(spark, folder, "in", [beat("b", 40)], BEATS)  # b's miss was told already
    assert missed() == [("a", 1), ("a", 6), ("b", 3)]
    land(spark, folder, "in", [beat("d", 60)], BEATS)
    assert missed() == [("a", 1), ("a", 6), ("b", 3), ("b", 40), ("c", 30)]


def test_topic_stream_names_the_missing_module(spark):
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        ingest.topic_stream(spark, "localhost:1", "t", schema_of(spark, EVENTS))


def test_enrichment_runs_adaptively_on_the_current_users(spark, folder, monkeypatch):
    schema, plans = schema_of(spark, EVENTS), []
    users = "user_id bigint, user_name string, user_email string"

    def watched(events, known):
        joined = original(events, known)
        plans.append(joined._jdf.queryExecution().executedPlan().toString())
        return joined

    original = ingest.enrich_events
    monkeypatch.setattr(ingest, "enrich_events", watched)

    def run():
        stream = ingest.file_stream(spark, f"{folder}/in", schema)
        ingest.run_available(ingest.enrich_stream(stream, lambda: spark.read.parquet(f"{folder}/users"), f"{folder}/out", f"{folder}/cp"))

    land(spark, folder, "users", [(1, "ann", "ann@x")], users)
    land(spark, folder, "in", [event(1, 1, 0), event(2, 2, 0)], EVENTS)
    run()
    land(spark, folder, "users", [(2, "bob", "bob@x")], users)
    land(spark, folder, "in", [event(3, 2, 0)], EVENTS)
    run()
    got = {r.event_id: r.user_name for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: "ann", 2: None, 3: "bob"}
    assert plans and all("AdaptiveSparkPlan" in p for p in plans)


def test_state_partitions_follow_the_input(spark, folder):
    cores = spark.sparkContext.defaultParallelism
    assert state_partitions(spark) == cores and state_partitions(spark, 1) == cores
    assert state_partitions(spark, 10**12) == -(-(10**12) // (32 * 1024 * 1024))
    assert path_bytes(spark, f"{folder}/none") == 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert stateful_session(spark).conf.get("spark.sql.shuffle.partitions") == str(cores)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_shuffles_are_sized_for_the_input(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert shuffle_partitions(10**14) == 745_059 and shuffle_partitions(10**12) == 7451
    size_shuffles(spark, 1000)
    assert spark.conf.get(name, None) is None
    size_shuffles(spark, 10**12)
    assert spark.conf.get(name) == "7451"
    size_shuffles(spark, 10**9)
    assert spark.conf.get(name) == "7451"
    spark.conf.unset(name)
