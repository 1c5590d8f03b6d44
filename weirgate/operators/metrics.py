"""Time-series style measures over run records: histograms, quantiles, rates, gauges and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weirgate.functions.times import seconds_between
from weirgate.operators.runs import newest_first
from weirgate.operators.windows import newest, running_total

# Duration bounds in seconds, doubling from 1; and the alert thresholds.
DURATION_BOUNDS = tuple(float(2**k) for k in range(12))
STALE_SECONDS = 7200
LONG_RUN_SECONDS = 3600
FAILURE_SHARE = 0.1


def success_rate(runs: DataFrame, keys: Sequence[str] = ("package", "environment")) -> DataFrame:
    """Share of successful runs per key; filter to the time range first."""
    total = F.count(F.lit(1))
    return runs.groupBy(*keys).agg(
        total.alias("total_runs"), (F.count_if(F.col("status") == "success").cast("double") / total).alias("success_rate")
    )


def duration_histogram(
    runs: DataFrame, keys: Sequence[str] = ("package",), bounds: Sequence[float] = DURATION_BOUNDS
) -> DataFrame:
    """Cumulative number of finished runs at or below each bound, plus the unbounded total.

    One pass with one counter per bound, so a key adds a single row to the shuffle from each task.
    """
    seconds = F.col("duration_ms") / F.lit(1000.0)
    edges = [*bounds, float("inf")]
    counters = [F.count_if(seconds <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(edges)]
    wide = runs.filter(F.col("duration_ms").isNotNull()).groupBy(*keys).agg(*counters)
    buckets = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(edges)]
    )
    return wide.select(*keys, F.inline(buckets))


def bucket_counts(histogram: DataFrame, keys: Sequence[str] = ("package",)) -> DataFrame:
    """The histogram with each bucket's lower bound and own count. A key has one row per bound."""
    by_bound = W.partitionBy(*keys).orderBy("le")
    previous = F.coalesce(F.lag("cumulative").over(by_bound), F.lit(0))
    return histogram.select(
        *keys,
        F.coalesce(F.lag("le").over(by_bound), F.lit(0.0)).alias("lower"),
        "le",
        (F.col("cumulative") - previous).alias("in_bucket"),
        "cumulative",
    )


def histogram_quantiles(
    histogram: DataFrame, quantiles: Sequence[float] = (0.5, 0.95, 0.99), keys: Sequence[str] = ("package",)
) -> DataFrame:
    """Quantiles interpolated inside the bucket they fall in.

    A quantile in the unbounded bucket gives the largest bound. Keys without observations are left out.
    """
    by_key = W.partitionBy(*keys)
    buckets = (
        bucket_counts(histogram, keys)
        .withColumn("total", F.max("cumulative").over(by_key))
        .filter(F.col("total") > 0)
        .withColumn("quantile", F.explode(F.array(*[F.lit(q) for q in quantiles])))
        .withColumn("rank", F.col("quantile") * F.col("total"))
        .filter(F.col("cumulative") >= F.col("rank"))
    )
    before = F.col("cumulative") - F.col("in_bucket")
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * ((F.col("rank") - before) / F.col("in_bucket"))
    value = F.when(F.col("le") == float("inf"), F.col("lower")).when(F.col("in_bucket") == 0, F.col("lower")).otherwise(inside)
    return buckets.groupBy(*keys, "quantile").agg(F.min_by(value, "le").alias("value"))


def sliding_sums(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    amount: Column,
    window_minutes: int,
    slide_minutes: int = 1,
) -> DataFrame:
    """Sum of ``amount`` in every window of the given length, one window per slide.

    Rows are added up per slide first; only those sums are copied into the windows that cover them.
    """
    if window_minutes % slide_minutes:
        raise ValueError("the window must be a multiple of the slide")
    steps = window_minutes // slide_minutes
    slide = F.window(F.col(at), f"{slide_minutes} minutes")
    per_slide = df.groupBy(*keys, slide.alias("__w")).agg(F.sum(amount).alias("__sum"))
    starts = F.transform(
        F.array(*[F.lit(i) for i in range(steps)]),
        lambda i: F.col("__w")["start"] - F.make_dt_interval(mins=i * F.lit(slide_minutes)),
    )
    return (
        per_slide.select(*keys, F.explode(starts).alias("window_start"), "__sum")
        .groupBy(*keys, "window_start")
        .agg(F.sum("__sum").alias("total"))
        .withColumn("window_end", F.col("window_start") + F.make_dt_interval(mins=F.lit(window_minutes)))
    )


def rate_per_second(
    df: DataFrame, keys: Sequence[str], at: str = "start_time", window_minutes: int = 5, slide_minutes: int = 1
) -> DataFrame:
    """Events per second over a sliding window, exact for the events given."""
    sums = sliding_sums(df, keys, at, F.lit(1), window_minutes, slide_minutes)
    return sums.withColumn("per_second", F.col("total") / F.lit(60.0 * window_minutes))


def increase(
    df: DataFrame, keys: Sequence[str], amount: Column, at: str = "start_time", window_minutes: int = 60, slide_minutes: int = 30
) -> DataFrame:
    """Growth of a counter over a sliding window."""
    return sliding_sums(df, keys, at, amount, window_minutes, slide_minutes)


def runs_by_status(runs: DataFrame, window: str = "5 minutes") -> DataFrame:
    return (
        runs.groupBy(F.window("start_time", window).alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("runs"))
        .select(F.col("w")["start"].alias("window_start"), "status", "runs")
    )


def failure_share(runs: DataFrame) -> DataFrame:
    """Failed runs and their share per package."""
    failed = F.count_if(F.col("status") == "failure")
    return runs.groupBy("package").agg(
        failed.alias("failed_runs"), (failed.cast("double") / F.count(F.lit(1))).alias("failure_share")
    )


def run_changes(runs: DataFrame) -> DataFrame:
    """+1 at each start and -1 at each end."""
    start = F.struct(F.col("start_time").alias("at"), F.lit(1).alias("change"))
    end = F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("change"))
    changes = F.when(F.col("end_time").isNull(), F.array(start)).otherwise(F.array(start, end))
    return runs.select(*[c for c in runs.columns if c not in ("start_time", "end_time")], F.inline(changes))


def in_progress_at(runs: DataFrame, at: Column, keys: Sequence[str] = ("package",)) -> DataFrame:
    """Runs started at or before an instant and not finished by it."""
    changes = run_changes(runs.select(*keys, "start_time", "end_time")).filter(F.col("at") <= at)
    return changes.groupBy(*keys).agg(F.sum("change").alias("in_progress"))


def in_progress_over_time(runs: DataFrame, keys: Sequence[str] = ("package",)) -> DataFrame:
    """Runs in progress after every instant at which the number changes hands."""
    changes = run_changes(runs.select(*keys, "start_time", "end_time"))
    return running_total(changes, keys, "at", "change", "in_progress")


def slowest_packages(runs: DataFrame, n: int = 10) -> DataFrame:
    """Packages with the largest mean duration."""
    mean = F.sum("duration_ms").cast("double") / F.count("duration_ms")
    return (
        runs.groupBy("package").agg(mean.alias("mean_duration_ms"))
        .orderBy(F.col("mean_duration_ms").desc_nulls_last(), "package").limit(n)
    )


def high_failure_alert(runs: DataFrame, window: str = "15 minutes", share: float = FAILURE_SHARE) -> DataFrame:
    """Windows in which more than the given share of a package's runs in an environment failed."""
    failed, total = F.count_if(F.col("status") == "failure"), F.count(F.lit(1))
    return (
        runs.groupBy("package", "environment", F.window("start_time", window).alias("w"))
        .agg(failed.alias("failed_runs"), total.alias("total_runs"))
        .withColumn("failure_share", F.col("failed_runs").cast("double") / F.col("total_runs"))
        .filter(F.col("failure_share") > share)
        .select("package", "environment", F.col("w")["start"].alias("window_start"), "failed_runs", "total_runs", "failure_share")
    )


def stale_packages(runs: DataFrame, as_of: Column, limit_seconds: int = STALE_SECONDS) -> DataFrame:
    """Packages whose last success ended longer ago than the limit, or that never succeeded."""
    last = F.max(F.when(F.col("status") == "success", F.col("end_time")))
    age = seconds_between(F.col("last_success"), as_of)
    return (
        runs.groupBy("package").agg(last.alias("last_success"))
        .withColumn("seconds_since", age)
        .filter(F.col("last_success").isNull() | (F.col("seconds_since") > limit_seconds))
    )


def silent_packages(expected: DataFrame, runs: DataFrame, since: Column) -> DataFrame:
    """Expected packages without any run since an instant."""
    recent = runs.filter(F.col("start_time") >= since).select("package").distinct()
    return expected.join(recent, "package", "left_anti")


def long_running(events: DataFrame, as_of: Column, limit_seconds: int = LONG_RUN_SECONDS) -> DataFrame:
    """Runs that started but have no ending event, older than the limit.

    One aggregation by run; the start and the missing end are read from the same pass.
    """
    started = F.max(F.when(F.col("event_type") == "START", F.col("event_time")))
    ended = F.bool_or(F.col("event_type").isin("COMPLETE", "FAIL", "ABORT"))
    return (
        events.groupBy("job_name", "run_id").agg(started.alias("started_at"), ended.alias("ended"))
        .filter(~F.col("ended") & F.col("started_at").isNotNull())
        .withColumn("running_seconds", seconds_between(F.col("started_at"), as_of))
        .filter(F.col("running_seconds") > limit_seconds)
        .select("job_name", "run_id", "started_at", "running_seconds")
    )


def jobs_with_latest_run(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every job with its newest run, or NULLs when it never ran."""
    latest = newest(runs, ("package",), newest_first()).select(
        F.col("package").alias("job_name"), F.col("id").alias("run_id"), F.col("status").alias("run_status"), "start_time"
    )
    return jobs.join(latest, "job_name", "left")


