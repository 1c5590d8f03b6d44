"""Run history: filters, pages, newest runs, statistics, health and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weirgate.functions.times import millis_between
from weirgate.operators.paging import page as page
from weirgate.operators.windows import newest, previous_value

# Fixed values of the run model.
ENVIRONMENTS = ("dev", "int", "prod")
STATUSES = ("pending", "running", "success", "failure", "cancelled")
STATS_RUNS = 10
HEALTH_RUNS = 5
UNHEALTHY_FAILURES = 3


def newest_first() -> list[Column]:
    return [F.col("start_time").desc(), F.col("id")]


def filter_runs(
    runs: DataFrame,
    package: str | None = None,
    namespace: str | None = None,
    environment: str | None = None,
    status: str | None = None,
    since: object | None = None,
    until: object | None = None,
) -> DataFrame:
    """Runs that meet every given term; both time bounds are inclusive and an empty term is no filter."""
    equal = {"package": package, "namespace": namespace, "environment": environment, "status": status}
    for name, value in equal.items():
        if value:
            runs = runs.filter(F.col(name) == value)
    if since is not None:
        runs = runs.filter(F.col("start_time") >= F.lit(since).cast(runs.schema["start_time"].dataType))
    if until is not None:
        runs = runs.filter(F.col("start_time") <= F.lit(until).cast(runs.schema["start_time"].dataType))
    return runs


def newest_runs(runs: DataFrame, n: int, keys: Sequence[str] = ("package", "environment")) -> DataFrame:
    """The ``n`` newest runs per key with their position in ``run_rank``; ties go to the smaller id."""
    return newest(runs, keys, newest_first(), n, rank="run_rank")


def latest_run(runs: DataFrame) -> DataFrame:
    return newest(runs, ("package", "environment"), newest_first())


def current_version(runs: DataFrame) -> DataFrame:
    """Version of the newest run per package and environment."""
    return latest_run(runs).select("package", "environment", F.col("version").alias("current_version"))


def _statistics() -> list[Column]:
    total = F.count(F.lit(1))
    success = F.count_if(F.col("status") == "success")
    duration = F.sum(F.coalesce("duration_ms", F.lit(0)))
    return [
        total.alias("total_runs"),
        success.alias("success_runs"),
        F.count_if(F.col("status") == "failure").alias("failure_runs"),
        (success.cast("double") / total * 100).alias("success_rate"),
        (duration.cast("double") / total).alias("avg_duration_ms"),
        F.sum(F.coalesce("records_processed", F.lit(0))).alias("total_records_processed"),
    ]


def run_statistics(runs: DataFrame) -> DataFrame:
    """Totals and averages over the 10 newest runs per package and environment.

    Every run counts in the denominators; a run without a duration counts as 0.
    """
    return newest_runs(runs, STATS_RUNS).groupBy("package", "environment").agg(*_statistics())


def _health() -> Column:
    checked = F.col("run_rank") <= HEALTH_RUNS
    failures = F.count_if(checked & (F.col("status") == "failure"))
    last_failed = F.coalesce(F.bool_or((F.col("run_rank") == 1) & (F.col("status") == "failure")), F.lit(False))
    return (
        F.when(last_failed & (failures >= UNHEALTHY_FAILURES), "unhealthy")
        .when(last_failed, "degraded")
        .when(failures > F.floor(F.count_if(checked) / 2), "degraded")
        .otherwise("healthy")
    )


def environment_health(runs: DataFrame) -> DataFrame:
    """Health per package and environment from its 5 newest runs."""
    recent = newest_runs(runs, HEALTH_RUNS)
    return recent.groupBy("package", "environment").agg(_health().alias("health"))


def _overall(health: DataFrame) -> DataFrame:
    counts = {
        state: F.count_if(F.col("environment").isin(*ENVIRONMENTS) & (F.col("health") == state))
        for state in ("healthy", "unhealthy", "degraded")
    }
    known = counts["healthy"] + counts["unhealthy"] + counts["degraded"]
    overall = (
        F.when(counts["unhealthy"] > 0, "unhealthy")
        .when(known == 0, "unknown")
        .when(counts["healthy"] == known, "healthy")
        .otherwise("degraded")
    )
    per_env = [
        F.coalesce(F.max(F.when(F.col("environment") == e, F.col("health"))), F.lit("unknown")).alias(f"{e}_health")
        for e in ENVIRONMENTS
    ]
    return health.groupBy("package").agg(*per_env, overall.alias("overall_health"))


def overall_health(runs: DataFrame, package: str | None = None) -> DataFrame:
    """Health of each package over its three environments; environments without runs are unknown.

    Per package and environment at most 5 rows survive the first shuffle, so the second one is small.
    """
    return _overall(environment_health(filter_runs(runs, package=package)))


def packages_status(runs: DataFrame) -> DataFrame:
    """Everything about every package in one job: per environment the newest run, version, statistics and
    health, for all environments including those without runs, plus the overall health.

    The newest 10 runs are picked once and serve all of it.
    """
    newest_run = F.max_by(
        F.struct("id", "status", "start_time", "version"), F.when(F.col("run_rank") == 1, F.lit(1))
    )
    per_env = (
        newest_runs(runs, STATS_RUNS)
        .groupBy("package", "environment")
        .agg(*_statistics(), _health().alias("health"), newest_run.alias("last"))
    )
    entry = F.struct(*[c for c in per_env.columns if c != "package"])
    counted = F.col("environment").isin(*ENVIRONMENTS)
    grouped = per_env.groupBy("package").agg(
        F.map_from_entries(F.collect_list(F.when(counted, F.struct("environment", entry)))).alias("known"),
        *_overall_columns(counted),
    )
    every = grouped.select(
        "package", "overall_health", "known", F.explode(F.array(*[F.lit(e) for e in ENVIRONMENTS])).alias("environment")
    )
    state = F.try_element_at("known", F.col("environment"))
    return every.select(
        "package",
        "environment",
        "overall_health",
        F.coalesce(state["health"], F.lit("unknown")).alias("health"),
        state["last"]["version"].alias("current_version"),
        state["last"]["id"].alias("last_run_id"),
        state["last"]["status"].alias("last_status"),
        *[
            state[c].alias(c)
            for c in (
                "total_runs", "success_runs", "failure_runs", "success_rate", "avg_duration_ms", "total_records_processed",
            )
        ],
    )


def _overall_columns(counted: Column) -> list[Column]:
    """Health over the counted rows; a package without any is unknown."""
    unhealthy = F.count_if(counted & (F.col("health") == "unhealthy"))
    healthy = F.count_if(counted & (F.col("health") == "healthy"))
    total = F.count_if(counted)
    overall = (
        F.when(total == 0, "unknown").when(unhealthy > 0, "unhealthy").when(healthy == total, "healthy").otherwise("degraded")
    )
    return [overall.alias("overall_health")]


def packages(runs: DataFrame) -> DataFrame:
    return runs.select("package").distinct()


def _amounts(runs: DataFrame) -> dict[str, str]:
    """What throughput is given for: records, and bytes where the runs have them."""
    both = {"records_processed": "records_per_second", "bytes_processed": "bytes_per_second"}
    return {amount: rate for amount, rate in both.items() if amount in runs.columns}


def throughput(runs: DataFrame) -> DataFrame:
    """Records and bytes per second of each run; NULL when the duration is zero or unknown."""
    seconds = F.col("duration_ms") / F.lit(1000.0)
    amounts = _amounts(runs)
    rates = [F.when(F.col("duration_ms") > 0, F.col(amount) / seconds).alias(rate) for amount, rate in amounts.items()]
    return runs.select("id", "package", *amounts, "duration_ms", *rates)


def package_throughput(runs: DataFrame) -> DataFrame:
    """Records and bytes per second per package: the total over the total time of runs that took any."""
    timed = runs.filter(F.col("duration_ms") > 0)
    amounts, millis = _amounts(runs), F.sum("duration_ms")
    sums = [F.sum(amount).alias(amount) for amount in amounts]
    rates = [(F.sum(amount) / (millis / F.lit(1000.0))).alias(rate) for amount, rate in amounts.items()]
    return timed.groupBy("package").agg(*sums, millis.alias("duration_ms"), *rates)


def last_errors(runs: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` failed runs per package."""
    return newest(runs.filter(F.col("status") == "failure"), ("package",), newest_first(), n, rank="error_rank")


def promotion_history(promotions: DataFrame, limit: int | None = None) -> DataFrame:
    """Promotions per package and target with the version each one replaced.

    The first promotion into an environment comes from the registry; later ones from the environment
    before it on the path. With ``limit``, the newest that many per package and target.
    """
    keys = ("package", "to_env")
    history = previous_value(promotions, keys, "promoted_at", "id", "version", "previous_version")
    source = F.when(F.col("previous_version").isNull(), "registry")
    path = ("registry", *ENVIRONMENTS)
    for before, target in zip(path, path[1:]):
        source = source.when(F.col("to_env") == target, before)
    history = history.withColumn("from_env", source.otherwise("unknown"))
    if limit is None:
        return history
    return newest(history, keys, [F.col("promoted_at").desc(), F.col("id")], limit)


def complete_runs(open_runs: DataFrame, completions: DataFrame) -> DataFrame:
    """Open runs, all their columns kept, with the outcome of their completion: status, end, duration and error, and
    records and bytes where the completions have them.

    Of several completions of a run the one that ended last counts, of equal ones that with the smaller status.
    Completions of unknown runs are left to :func:`weirgate.sources.keyed.rejected_changes`.
    """
    given = [c for c in ("status", "end_time", "records_processed", "bytes_processed", "error_message") if c in completions.columns]
    last = newest(completions.select("id", *given), ("id",), [F.col("end_time").desc_nulls_last(), F.col("status")])
    outcome = last.select("id", *[F.col(c).alias(f"__{c}") for c in given])
    values = {c: F.col(f"__{c}") for c in given}
    values["status"] = F.coalesce("__status", "status")
    values["duration_ms"] = millis_between(F.col("start_time"), F.col("__end_time"))
    kept = [F.col(c) for c in open_runs.columns if c not in values]
    return open_runs.join(outcome, "id", "left").select(*kept, *[v.alias(c) for c, v in values.items()])


def audit_trail(*events: DataFrame) -> DataFrame:
    """One timeline from tables of (at, actor, package, action, detail), oldest first."""
    columns = ["at", "actor", "package", "action", "detail"]
    timeline = events[0].select(*columns)
    for more in events[1:]:
        timeline = timeline.unionByName(more.select(*columns))
    return timeline.orderBy("at", "package", "action", "detail")


def search_logs(
    logs: DataFrame,
    run_id: str | None = None,
    level: str | None = None,
    package: str | None = None,
    since: object | None = None,
    tail: int | None = 100,
) -> DataFrame:
    """Log lines that meet every given term; the newest ``tail`` of them, oldest first."""
    for name, value in {"run_id": run_id, "level": level, "package": package}.items():
        if value:
            logs = logs.filter(F.col(name) == value)
    if since is not None:
        logs = logs.filter(F.col("timestamp") >= F.lit(since).cast(logs.schema["timestamp"].dataType))
    if tail is None:
        return logs.orderBy("timestamp", "run_id", "msg")
    last = logs.orderBy(F.col("timestamp").desc(), F.col("run_id").desc(), F.col("msg").desc()).limit(tail)
    return last.orderBy("timestamp", "run_id", "msg")
