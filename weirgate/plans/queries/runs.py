"""Run history, statistics, health, metrics and alerts."""

from pyspark.sql import functions as F

from weirgate.operators import metrics as M
from weirgate.operators import runs as R
from weirgate.plans.registry import query

AS_OF = "2024-01-30 23:00:00"


def at(text=AS_OF):
    return F.lit(text).cast("timestamp_ntz")


RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY package, environment ORDER BY start_time DESC, id) AS rn FROM runs)"""
HEALTH = """health AS (
  SELECT package, environment,
         CASE WHEN bool_or(rn = 1 AND status = 'failure') THEN CASE WHEN count(*) FILTER (WHERE status = 'failure') >= 3 THEN 'unhealthy' ELSE 'degraded' END
              WHEN count(*) FILTER (WHERE status = 'failure') > count(*) // 2 THEN 'degraded' ELSE 'healthy' END AS health
  FROM ranked WHERE rn <= 5 GROUP BY package, environment)"""
STATS = """count(*) AS total_runs, count(*) FILTER (WHERE status = 'success') AS success_runs,
           count(*) FILTER (WHERE status = 'failure') AS failure_runs,
           CAST(count(*) FILTER (WHERE status = 'success') AS DOUBLE) / count(*) * 100 AS success_rate,
           CAST(sum(coalesce(duration_ms, 0)) AS DOUBLE) / count(*) AS avg_duration_ms,
           CAST(sum(coalesce(records_processed, 0)) AS BIGINT) AS total_records_processed"""


@query(
    "P7",
    """SELECT id, package, start_time FROM runs WHERE environment = 'prod' AND status = 'failure'
       AND start_time >= TIMESTAMP '2024-01-10 00:00:00' AND start_time <= TIMESTAMP '2024-01-20 00:00:00'""",
)
def filtered_runs(t):
    found = R.filter_runs(
        t.runs, environment="prod", status="failure", since="2024-01-10 00:00:00", until="2024-01-20 00:00:00"
    )
    return found.select("id", "package", "start_time")


@query(
    "G1",
    """SELECT id, start_time, (SELECT count(*) FROM runs WHERE environment = 'prod') AS total
       FROM runs WHERE environment = 'prod' ORDER BY start_time DESC, id LIMIT 20 OFFSET 40""",
)
def runs_page(t):
    found = R.filter_runs(t.runs, environment="prod").select("id", "start_time")
    return R.page(found, limit=20, offset=40)


@query(
    "G1",
    """SELECT event_id AS id, ts AS start_time, (SELECT count(*) FROM events) AS total FROM events
       ORDER BY ts DESC, event_id LIMIT 5000 OFFSET 7000""",
)
def deep_page(t):
    events = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("start_time"))
    return R.page(events, limit=5000, offset=7000)


@query("F1", f"WITH {RANKED} SELECT package, environment, id, CAST(rn AS INTEGER) AS run_rank FROM ranked WHERE rn <= 10")
def newest_runs(t):
    return R.newest_runs(t.runs, 10).select("package", "environment", "id", "run_rank")


@query("F2", f"WITH {RANKED} SELECT package, environment, id, status, start_time FROM ranked WHERE rn = 1")
def latest_runs(t):
    return R.latest_run(t.runs).select("package", "environment", "id", "status", "start_time")


@query("F3", f"WITH {RANKED} SELECT package, environment, version AS current_version FROM ranked WHERE rn = 1")
def current_versions(t):
    return R.current_version(t.runs)


@query("A4", f"WITH {RANKED} SELECT package, environment, {STATS} FROM ranked WHERE rn <= 10 GROUP BY package, environment")
def run_statistics(t):
    return R.run_statistics(t.runs)


@query("A5", f"WITH {RANKED}, {HEALTH} SELECT * FROM health")
def environment_health(t):
    return R.environment_health(t.runs)


OVERALL = """overall AS (
  SELECT package,
         coalesce(max(health) FILTER (WHERE environment = 'dev'), 'unknown') AS dev_health,
         coalesce(max(health) FILTER (WHERE environment = 'int'), 'unknown') AS int_health,
         coalesce(max(health) FILTER (WHERE environment = 'prod'), 'unknown') AS prod_health,
         CASE WHEN bool_or(health = 'unhealthy') THEN 'unhealthy' WHEN bool_and(health = 'healthy') THEN 'healthy'
              ELSE 'degraded' END AS overall_health
  FROM health GROUP BY package)"""


@query("A6", f"WITH {RANKED}, {HEALTH}, {OVERALL} SELECT * FROM overall")
def overall_health(t):
    return R.overall_health(t.runs)


@query(
    "A7",
    f"""WITH {RANKED}, {HEALTH}, {OVERALL},
        stats AS (SELECT package, environment, {STATS},
                         max(id) FILTER (WHERE rn = 1) AS last_run_id, max(status) FILTER (WHERE rn = 1) AS last_status,
                         max(version) FILTER (WHERE rn = 1) AS current_version
                  FROM ranked WHERE rn <= 10 GROUP BY package, environment)
        SELECT o.package, e.environment, o.overall_health, coalesce(h.health, 'unknown') AS health, s.current_version,
               s.last_run_id, s.last_status, s.total_runs, s.success_runs, s.failure_runs, s.success_rate,
               s.avg_duration_ms, s.total_records_processed
        FROM overall o CROSS JOIN (VALUES ('dev'), ('int'), ('prod')) AS e(environment)
        LEFT JOIN health h ON h.package = o.package AND h.environment = e.environment
        LEFT JOIN stats s ON s.package = o.package AND s.environment = e.environment""",
)
def all_packages_status(t):
    return R.packages_status(t.runs)


@query("A23", "SELECT DISTINCT package FROM runs")
def distinct_packages(t):
    return R.packages(t.runs)


@query(
    "A8",
    """SELECT package, environment, count(*) AS total_runs,
              CAST(count(*) FILTER (WHERE status = 'success') AS DOUBLE) / count(*) AS success_rate
       FROM runs WHERE start_time >= TIMESTAMP '2024-01-15 00:00:00' AND start_time <= TIMESTAMP '2024-01-16 00:00:00'
       GROUP BY package, environment""",
)
def success_rates(t):
    return M.success_rate(R.filter_runs(t.runs, since="2024-01-15 00:00:00", until="2024-01-16 00:00:00"))


HISTOGRAM = """bounds AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 'Infinity'::DOUBLE]) AS le),
  hist AS (SELECT package, le, count(*) FILTER (WHERE duration_ms / CAST(1000 AS DOUBLE) <= le) AS cumulative
           FROM runs CROSS JOIN bounds WHERE duration_ms IS NOT NULL GROUP BY package, le),
  buckets AS (SELECT package, coalesce(lag(le) OVER w, 0) AS lower, le, cumulative - coalesce(lag(cumulative) OVER w, 0) AS in_bucket,
                     cumulative FROM hist WINDOW w AS (PARTITION BY package ORDER BY le))"""


@query("A9", f"WITH {HISTOGRAM} SELECT package, le, cumulative FROM hist")
def duration_histogram(t):
    return M.duration_histogram(t.runs)


@query("F6", f"WITH {HISTOGRAM} SELECT * FROM buckets")
def duration_buckets(t):
    return M.bucket_counts(M.duration_histogram(t.runs))


@query(
    "A10",
    f"""WITH {HISTOGRAM},
        totals AS (SELECT package, max(cumulative) AS total FROM buckets GROUP BY package),
        found AS (SELECT b.*, CAST(q.quantile AS DOUBLE) AS quantile, CAST(q.quantile AS DOUBLE) * total AS rank,
                         row_number() OVER (PARTITION BY package, q.quantile ORDER BY le) AS rn
                  FROM buckets b JOIN totals USING (package) CROSS JOIN (VALUES (0.5), (0.95), (0.99)) AS q(quantile)
                  WHERE cumulative >= CAST(q.quantile AS DOUBLE) * total)
        SELECT package, quantile,
               CASE WHEN isinf(le) OR in_bucket = 0 THEN lower
                    ELSE lower + (le - lower) * ((rank - (cumulative - in_bucket)) / in_bucket) END AS value
        FROM found WHERE rn = 1""",
)
def duration_quantiles(t):
    return M.histogram_quantiles(M.duration_histogram(t.runs))


@query(
    "A11",
    """SELECT package, window_start, CAST(count(*) AS BIGINT) AS total, window_start + INTERVAL '5' MINUTE AS window_end,
              count(*) / CAST(300 AS DOUBLE) AS per_second
       FROM (SELECT package, date_trunc('minute', start_time) - unnest([0, 1, 2, 3, 4]) * INTERVAL '1' MINUTE AS window_start FROM runs)
       GROUP BY package, window_start""",
)
def run_rates(t):
    return M.rate_per_second(t.runs, ["package"])


@query(
    "A11",
    """SELECT environment, window_start, CAST(sum(records_processed) AS BIGINT) AS total,
              window_start + INTERVAL '60' MINUTE AS window_end
       FROM (SELECT environment, records_processed,
                    time_bucket(INTERVAL '30' MINUTE, start_time) - unnest([0, 30]) * INTERVAL '1' MINUTE AS window_start FROM runs)
       GROUP BY environment, window_start""",
)
def records_increase(t):
    return M.increase(t.runs, ["environment"], F.col("records_processed"))


@query(
    "A12",
    """SELECT package, CAST(sum(change) AS BIGINT) AS in_progress FROM (
         SELECT package, start_time AS "at", 1 AS change FROM runs
         UNION ALL SELECT package, end_time, -1 FROM runs WHERE end_time IS NOT NULL)
       WHERE "at" <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY package""",
)
def runs_in_progress(t):
    return M.in_progress_at(t.runs, at("2024-01-15 12:00:00"))


@query(
    "F5 A12",
    """WITH changes AS (SELECT package, start_time AS "at", 1 AS change FROM runs
                        UNION ALL SELECT package, end_time, -1 FROM runs WHERE end_time IS NOT NULL),
            instants AS (SELECT package, "at", CAST(sum(change) AS BIGINT) AS change FROM changes GROUP BY package, "at")
       SELECT package, "at", change, CAST(sum(change) OVER (PARTITION BY package ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_progress
       FROM instants""",
)
def concurrent_runs(t):
    return M.in_progress_over_time(t.runs)


@query(
    "A13",
    """SELECT package, CAST(sum(duration_ms) AS DOUBLE) / count(duration_ms) AS mean_duration_ms FROM runs
       GROUP BY package ORDER BY 2 DESC NULLS LAST, package LIMIT 10""",
)
def slowest_packages(t):
    return M.slowest_packages(t.runs)


@query(
    "A14",
    """SELECT package, environment, time_bucket(INTERVAL '15' MINUTE, start_time) AS window_start,
              count(*) FILTER (WHERE status = 'failure') AS failed_runs, count(*) AS total_runs,
              CAST(count(*) FILTER (WHERE status = 'failure') AS DOUBLE) / count(*) AS failure_share
       FROM runs GROUP BY 1, 2, 3
       HAVING CAST(count(*) FILTER (WHERE status = 'failure') AS DOUBLE) / count(*) > CAST(0.1 AS DOUBLE)""",
)
def high_failure_windows(t):
    return M.high_failure_alert(t.runs)


@query(
    "A15",
    f"""SELECT * FROM (
          SELECT package, max(end_time) FILTER (WHERE status = 'success') AS last_success,
                 CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(end_time) FILTER (WHERE status = 'success'))) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS seconds_since
          FROM runs GROUP BY package)
        WHERE last_success IS NULL OR seconds_since > 7200""",
)
def stale_packages(t):
    return M.stale_packages(t.runs, at())


@query(
    "A15",
    f"""SELECT DISTINCT package FROM runs WHERE package NOT IN
          (SELECT package FROM runs WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL '6' HOUR)""",
)
def silent_packages(t):
    return M.silent_packages(R.packages(t.runs), t.runs, at() - F.expr("INTERVAL '6' HOUR"))


@query(
    "A24",
    """SELECT id, package, records_processed, duration_ms,
              CASE WHEN duration_ms > 0 THEN records_processed / (duration_ms / CAST(1000 AS DOUBLE)) END AS records_per_second FROM runs""",
)
def run_throughput(t):
    return R.throughput(t.runs)


@query(
    "A24",
    """SELECT package, CAST(sum(records_processed) AS BIGINT) AS records_processed, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
              sum(records_processed) / (sum(duration_ms) / CAST(1000 AS DOUBLE)) AS records_per_second
       FROM runs WHERE duration_ms > 0 GROUP BY package""",
)
def package_throughput(t):
    return R.package_throughput(t.runs)


@query(
    "A25",
    "SELECT time_bucket(INTERVAL '5' MINUTE, start_time) AS window_start, status, count(*) AS runs FROM runs GROUP BY 1, 2",
)
def runs_by_status(t):
    return M.runs_by_status(t.runs)


@query(
    "A25",
    """SELECT package, count(*) FILTER (WHERE status = 'failure') AS failed_runs,
              CAST(count(*) FILTER (WHERE status = 'failure') AS DOUBLE) / count(*) AS failure_share FROM runs GROUP BY package""",
)
def failure_shares(t):
    return M.failure_share(t.runs)


@query(
    "F8",
    """SELECT id, package, to_env, version, lag(version) OVER w AS previous_version,
              CASE WHEN lag(version) OVER w IS NULL THEN 'registry' ELSE
                   CASE to_env WHEN 'dev' THEN 'registry' WHEN 'int' THEN 'dev' ELSE 'int' END END AS from_env
       FROM promotions WINDOW w AS (PARTITION BY package, to_env ORDER BY promoted_at, id)""",
)
def promotion_history(t):
    history = R.promotion_history(t.promotions)
    return history.select("id", "package", "to_env", "version", "previous_version", "from_env")


@query(
    "F9",
    """SELECT package, id, start_time FROM runs WHERE status = 'failure'
       QUALIFY row_number() OVER (PARTITION BY package ORDER BY start_time DESC, id) <= 10""",
)
def last_errors(t):
    return R.last_errors(t.runs).select("package", "id", "start_time")


@query(
    "P16 G4",
    """SELECT * FROM (SELECT "timestamp", run_id, msg FROM logs WHERE level = 'ERROR' AND "timestamp" >= TIMESTAMP '2024-01-10 00:00:00'
                      ORDER BY "timestamp" DESC, run_id DESC, msg DESC LIMIT 100)""",
)
def log_search(t):
    found = R.search_logs(t.logs, level="ERROR", since="2024-01-10 00:00:00", tail=100)
    return found.select("timestamp", "run_id", "msg")


@query(
    "J10",
    f"""SELECT job_name, run_id, started_at, running_seconds FROM (
          SELECT job_name, run_id, max(event_time) FILTER (WHERE event_type = 'START') AS started_at,
                 bool_or(event_type IN ('COMPLETE', 'FAIL', 'ABORT')) AS ended,
                 CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(event_time) FILTER (WHERE event_type = 'START'))) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS running_seconds
          FROM lineage_events GROUP BY job_name, run_id)
        WHERE NOT ended AND running_seconds > 3600""",
)
def long_running_jobs(t):
    return M.long_running(t.lineage_events, at())


@query(
    "J11",
    """SELECT job_name, r.id AS run_id, r.status AS run_status, r.start_time
       FROM (SELECT concat('pkg-', CAST(c_custkey AS STRING)) AS job_name FROM customer)
       LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY package ORDER BY start_time DESC, id) = 1) r
         ON r.package = job_name""",
)
def jobs_latest_run(t):
    jobs = t.customer.select(F.concat(F.lit("pkg-"), F.col("c_custkey").cast("string")).alias("job_name"))
    return M.jobs_with_latest_run(jobs, t.runs)


@query(
    "U5",
    """SELECT promoted_at AS "at", initiated_by AS actor, package, 'PROMOTED' AS action, concat(version, ' -> ', to_env) AS detail FROM promotions
       UNION ALL SELECT end_time, 'system', package, 'RUN', concat(id, ' ', status) FROM runs WHERE end_time IS NOT NULL""",
)
def audit_trail(t):
    promoted = t.promotions.select(
        F.col("promoted_at").alias("at"), F.col("initiated_by").alias("actor"), "package",
        F.lit("PROMOTED").alias("action"), F.concat_ws(" -> ", "version", "to_env").alias("detail"),
    )
    ran = t.runs.filter(F.col("end_time").isNotNull()).select(
        F.col("end_time").alias("at"), F.lit("system").alias("actor"), "package",
        F.lit("RUN").alias("action"), F.concat_ws(" ", "id", "status").alias("detail"),
    )
    return R.audit_trail(promoted, ran)
