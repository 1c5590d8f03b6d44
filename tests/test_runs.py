import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirgate.operators import metrics as M
from weirgate.operators import paging
from weirgate.operators import runs as R

START = datetime(2024, 1, 1)
SCHEMA = "id string, package string, environment string, status string, start_time timestamp_ntz, duration_ms bigint, records_processed bigint, version string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def history(package, env, statuses):
    """Runs with the given statuses, newest first."""
    return [
        (f"{package}-{env}-{i:02d}", package, env, s, START - timedelta(hours=i), 1000 if s != "running" else None, 10, f"1.0.{i}")
        for i, s in enumerate(statuses)
    ]


def brute_health(statuses):
    checked = statuses[:5]
    if not checked:
        return "unknown"
    failures = checked.count("failure")
    if checked[0] == "failure":
        return "unhealthy" if failures >= 3 else "degraded"
    return "degraded" if failures > len(checked) // 2 else "healthy"


def brute_overall(states):
    if "unhealthy" in states:
        return "unhealthy"
    unknown = states.count("unknown")
    if unknown == 3:
        return "unknown"
    return "healthy" if states.count("healthy") == 3 - unknown else "degraded"


@pytest.fixture(scope="module")
def histories():
    rng = random.Random(11)
    made = {}
    for p in range(40):
        for env in R.ENVIRONMENTS:
            n = rng.choice([0, 1, 2, 3, 4, 5, 7, 14])
            made[f"p{p}", env] = [rng.choice(["failure", "failure", "success", "running", "cancelled"]) for _ in range(n)]
    made["hot", "dev"] = [rng.choice(["failure", "success"]) for _ in range(600)]
    made["hot", "int"] = made["hot", "prod"] = []
    return made


@pytest.fixture(scope="module")
def runs(spark, histories):
    return frame(spark, [r for (p, e), s in histories.items() for r in history(p, e, s)]).cache()


def test_health(runs, histories):
    got = {(r.package, r.environment): r.health for r in R.environment_health(runs).collect()}
    assert got == {k: brute_health(s) for k, s in histories.items() if s}


def test_overall_health_and_status(runs, histories):
    packages = {p for (p, _), s in histories.items() if s}
    expected = {p: brute_overall([brute_health(histories[p, e]) for e in R.ENVIRONMENTS]) for p in packages}
    assert {r.package: r.overall_health for r in R.overall_health(runs).collect()} == expected
    status = R.packages_status(runs).collect()
    assert len(status) == 3 * len(packages)
    for r in status:
        recent = histories[r.package, r.environment][:10]
        assert r.overall_health == expected[r.package]
        assert r.health == brute_health(recent)
        assert r.total_runs == (len(recent) or None)
        assert r.current_version == ("1.0.0" if recent else None)


def test_packages_outside_the_environments_are_unknown(spark):
    runs = frame(spark, history("p", "sandbox", ["failure"] * 3) + history("q", None, ["success"]) + history("r", "dev", ["success"]))
    expected = {"p": "unknown", "q": "unknown", "r": "healthy"}
    assert {r.package: r.overall_health for r in R.overall_health(runs).collect()} == expected
    status = R.packages_status(runs).collect()
    assert {r.package: r.overall_health for r in status} == expected and len(status) == 9
    assert all(r.health == "unknown" for r in status if r.package != "r")


def test_completion_keeps_columns_and_counts_once(spark):
    opened = frame(spark, history("p", "dev", ["running", "running"])).drop("records_processed")
    done = spark.createDataFrame(
        [("p-dev-00", "failure", START, 5, 50), ("p-dev-00", "success", START + timedelta(seconds=2), 7, 70), ("gone", "success", START, 1, 1)],
        "id string, status string, end_time timestamp_ntz, records_processed bigint, bytes_processed bigint",
    )
    got = {r.id: r for r in R.complete_runs(opened, done).collect()}
    assert len(got) == 2 and got["p-dev-01"].status == "running" and got["p-dev-01"].bytes_processed is None
    first = got["p-dev-00"]
    assert (first.status, first.duration_ms, first.records_processed, first.bytes_processed, first.version) == ("success", 2000, 7, 70, "1.0.0")
    rates = {r.id: r for r in R.throughput(R.complete_runs(opened, done)).collect()}
    assert (rates["p-dev-00"].bytes_per_second, rates["p-dev-01"].bytes_per_second) == (35.0, None)
    assert R.package_throughput(R.complete_runs(opened, done)).first().bytes_per_second == 35.0


def test_statistics_divide_by_all_runs(spark):
    runs = frame(spark, history("p", "dev", ["running", "success", "failure", "success"]))
    row = R.run_statistics(runs).first()
    assert (row.total_runs, row.success_runs, row.failure_runs) == (4, 2, 1)
    assert row.success_rate == 50.0 and row.avg_duration_ms == 750.0 and row.total_records_processed == 40


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "p", "dev", s, START, 1, 1, "1") for i, s in (("b", "success"), ("a", "failure"), ("c", "success"))]
    assert R.latest_run(frame(spark, rows)).first()["id"] == "a"
    assert R.environment_health(frame(spark, rows)).first()["health"] == "degraded"


def test_no_runs(spark):
    empty = frame(spark, [])
    assert R.packages_status(empty).collect() == [] and R.overall_health(empty).collect() == []
    assert R.page(empty, limit=5).collect() == []


@pytest.mark.parametrize("limit,offset", [(5, 0), (7, 30), (10, 595), (5, 5000)])
@pytest.mark.parametrize("deep", [False, True])
def test_pages(runs, histories, monkeypatch, limit, offset, deep):
    monkeypatch.setattr(paging, "FEW", 0 if deep else 100_000)
    everything = sorted((r for (p, e), s in histories.items() for r in history(p, e, s)), key=lambda r: (-r[4].timestamp(), r[0]))
    got = R.page(runs, limit, offset).collect()
    assert [r.id for r in got] == [r[0] for r in everything[offset : offset + limit]]
    assert {r.total for r in got} <= {len(everything)}


def test_pages_put_undated_rows_last(spark, monkeypatch):
    rows = history("p", "dev", ["success"] * 5) + [(f"u{i}", "p", "dev", "success", None, 1, 1, "1") for i in range(4)]
    expected = [r.id for r in R.page(frame(spark, rows), 9).collect()]
    monkeypatch.setattr(paging, "FEW", 0)
    for offset in range(0, 9, 2):
        assert [r.id for r in R.page(frame(spark, rows), 3, offset).collect()] == expected[offset : offset + 3]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_page_among_a_million_equal_instants(spark, kind):
    ids = f"CAST(id * 7919 % 1000003 - 500000 AS {kind})"
    many = spark.range(1_000_003).selectExpr(f"{ids} AS id", "TIMESTAMP_NTZ '2024-03-01 12:00:00' AS start_time")
    around = spark.range(3).selectExpr(f"CAST(id AS {kind}) AS id", "CASE id WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP_NTZ '2024-03-01 12:00:00.000001' ELSE TIMESTAMP_NTZ '2020-01-01 00:00:00' END AS start_time")
    df = many.unionByName(around)
    ordered = sorted(range(-500_000, 500_003), key=int if kind == "bigint" else lambda i: str(i).encode())
    place = str if kind == "string" else int
    for offset in (0, 654_321, 1_000_002):
        wanted = ([place(1)] + [place(i) for i in ordered] + [place(2), place(0)])[offset : offset + 40]
        assert [r.id for r in R.page(df, 40, offset).collect()] == wanted
    types = {f.name: f.dataType for f in df.schema}
    numbers = [*paging.order_numbers("start_time", types["start_time"], True), *paging.order_numbers("id", types["id"])]
    parts = paging.located(df, numbers, 654_321, 40, 1_000_006)
    assert sum(length for *_, length in parts) == 40
    assert all(part.count() <= paging.FEW for part, *_ in parts)


def test_a_long_page_takes_whole_buckets(spark, monkeypatch):
    monkeypatch.setattr(paging, "FEW", 10)
    df = spark.range(5000).selectExpr("CAST(id AS string) AS id", "timestampadd(SECOND, CAST(id % 40 AS int), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS start_time")
    everything = [r.id for r in df.orderBy(F.col("start_time").desc(), "id").collect()]
    assert [r.id for r in R.page(df, 700, 333).collect()] == everything[333:1033]


def test_filter_bounds_are_inclusive(spark):
    runs = frame(spark, history("p", "dev", ["success"] * 4))
    found = R.filter_runs(runs, package="p", since=START - timedelta(hours=2), until=START - timedelta(hours=1))
    assert found.count() == 2
    assert R.filter_runs(runs, package="", environment=None).count() == 4


def test_quantiles_interpolate(spark):
    rows = [(str(i), "p", "dev", "success", START, d, 1, "1") for i, d in enumerate([500, 1500, 3000, 3500, 5_000_000])]
    histogram = M.duration_histogram(frame(spark, rows))
    values = {r.le: r.cumulative for r in histogram.collect()}
    assert values[1.0] == 1 and values[2.0] == 2 and values[4.0] == 4 and values[2048.0] == 4 and values[float("inf")] == 5
    got = {r.quantile: r.value for r in M.histogram_quantiles(histogram, (0.1, 0.5, 0.99)).collect()}
    assert got == {0.1: 0.5, 0.5: 2.0 + 2.0 * (0.5 / 2), 0.99: 2048.0}


def test_sliding_sums_match_counting(spark):
    rng = random.Random(5)
    times = [START + timedelta(seconds=rng.randint(0, 2000)) for _ in range(300)]
    df = spark.createDataFrame([("a", t) for t in times], "k string, start_time timestamp_ntz")
    got = {r.window_start: r.total for r in M.rate_per_second(df, ["k"]).collect()}
    for start, total in got.items():
        assert total == sum(start <= t < start + timedelta(minutes=5) for t in times)
    assert sum(got.values()) == 5 * len(times)


def test_promotion_history_sources(spark):
    rows = [("1", "p", "1.0", "int", START), ("2", "p", "1.1", "int", START + timedelta(days=3)), ("3", "p", "1.0", "prod", START)]
    df = spark.createDataFrame(rows, "id string, package string, version string, to_env string, promoted_at timestamp_ntz")
    got = {r.id: (r.previous_version, r.from_env) for r in R.promotion_history(df).collect()}
    assert got == {"1": (None, "registry"), "2": ("1.0", "dev"), "3": (None, "registry")}
    assert [r.id for r in R.promotion_history(df, limit=1).orderBy("id").collect()] == ["2", "3"]
