"""Event projections, enrichment, rollups, SQL models and staged transforms."""

from pyspark.sql import functions as F

from weirgate.contracts import Contract, conform, conformance_report, read_together
from weirgate.operators import events as E
from weirgate.operators.quality import column_profile, model_tests
from weirgate.plans.digests import text_sql
from weirgate.plans.models import python_transform, run_model, run_stages
from weirgate.plans.registry import query
from weirgate.session import written

RESHAPED = {
    "event_id": "id", "user_id": "user_id", "event_type": "type", "timestamp": "timestamp",
    "session": "session_id", "properties": "properties",
}
STAMP = "2024-02-01 00:00:00"


def raw_events(events):
    """The events table in the shape of the raw topic: short names and nested properties."""
    return events.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("type"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") != "view", F.from_json("props", "k BIGINT")).alias("properties"),
    )


def stamp():
    return F.lit(STAMP).cast("timestamp_ntz")


@query(
    "P1 P2 P3",
    f"""SELECT event_id, user_id, event_type, ts AS "timestamp", CAST(NULL AS VARCHAR) AS session,
               CASE WHEN event_type = 'view' THEN '{{}}'
                    ELSE concat('{{"k":', regexp_extract(props, '([0-9]+)', 1), '}}') END AS properties,
               TIMESTAMP '{STAMP}' AS processed_at FROM events""",
)
def reshape_events(t):
    return E.reshape_events(raw_events(t.events), RESHAPED, stamp())


@query(
    "P4",
    """SELECT o_orderkey AS id, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
              TRY_CAST(o_orderstatus AS INTEGER) AS status_code,
              CAST(o_orderdate AS DATE) AS ordered_on FROM orders""",
)
def cast_to_contract(t):
    contract = Contract.from_dict(
        {
            "name": "orders",
            "schema": [
                {"name": "id", "type": "INT64"},
                {"name": "priority", "type": "Integer"},
                {"name": "status_code", "type": "INT32"},
                {"name": "ordered_on", "type": "date"},
            ],
        }
    )
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.col("o_orderstatus").alias("status_code"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered_on"),
    )
    return conform(text, contract)


@query("P6", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS email, c_name FROM customer")
def align_columns(t):
    contract = Contract.from_dict(
        {"name": "c", "schema": [{"name": "c_custkey", "type": "bigint"}, {"name": "email"}, {"name": "c_name"}]}
    )
    return conform(t.customer, contract)


@query(
    "P11",
    """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00'""",
)
def backfill_range(t):
    return E.date_range(t.events, "ts", "2024-01-05", "2024-01-12").select("event_id", "ts")


@query("J1", "SELECT event_id, user_id, event_type, user_name, user_email FROM events LEFT JOIN users USING (user_id)")
def enrich_events(t):
    return E.enrich_events(t.events, t.users).select("event_id", "user_id", "event_type", "user_name", "user_email")


MODEL = """
SELECT concat('user-', CAST(user_id AS STRING)) AS name, MIN(ts) AS first_seen, COUNT(event_id) AS row_count
FROM {{ source('lake', 'events') }}
GROUP BY user_id
ORDER BY first_seen, name
"""
NAME_SUMMARY = """SELECT concat('user-', CAST(user_id AS STRING)) AS name, min(ts) AS first_seen, count(*) AS row_count
                  FROM events GROUP BY user_id ORDER BY first_seen, name"""


def named_events(t):
    return t.events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"), F.col("ts").alias("created_at"),
        F.col("event_id").alias("id"),
    )


@query("A1 G2", NAME_SUMMARY)
def name_summary(t):
    return E.name_summary(named_events(t))


@query("V2", NAME_SUMMARY)
def sql_model(t):
    return run_model(t.spark, MODEL, {"lake.events": t.events})


@query(
    "V3",
    """SELECT 'event_type' AS column_name, 'not_null' AS test, count(*) FILTER (WHERE event_type IS NULL) AS violations FROM events
       UNION ALL SELECT 'severity', 'not_null', count(*) FILTER (WHERE event_type = 'view') FROM events
       UNION ALL SELECT 'event_id', 'unique', count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'user_id', 'unique', count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)""",
)
def column_tests(t):
    df = t.events.withColumn("severity", F.when(F.col("event_type") != "view", F.length("event_type")))
    return model_tests(
        df, {"event_type": ["not_null"], "severity": ["not_null"], "event_id": ["unique"], "user_id": ["unique"]}
    )


@query(
    "A2",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, event_type, count(*) AS total_events, count(DISTINCT user_id) AS unique_users
       FROM events GROUP BY 1, 2""",
)
def daily_rollup(t):
    return E.daily_rollup(t.events)


@query(
    "A2",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, count(*) AS total_events, count(DISTINCT event_type) AS event_types
       FROM events GROUP BY 1, 2""",
)
def daily_user_summary(t):
    return E.daily_user_summary(t.events)


@query("A3", "SELECT l_orderkey, l_shipdate, l_returnflag, count(*) AS total_count FROM lineitem GROUP BY 1, 2, 3")
def count_per_key(t):
    return E.count_by(t.lineitem, "l_orderkey", "l_shipdate", "l_returnflag")


@query("G5", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def table_preview(t):
    return E.preview(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("V1", "SELECT event_id, upper(event_type) AS event_type, value * 2.0 AS doubled FROM events")
def python_rows(t):
    contract = Contract.from_dict(
        {
            "name": "doubled",
            "schema": [{"name": "event_id", "type": "bigint"}, {"name": "event_type"}, {"name": "doubled", "type": "float"}],
        }
    )

    def transform(batches):
        for b in batches:
            yield b.assign(event_type=b["event_type"].str.upper(), doubled=b["value"] * 2.0)[
                ["event_id", "event_type", "doubled"]
            ]

    return python_transform(transform, contract)(t.events.select("event_id", "event_type", "value"))


@query(
    "V5",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, event_type, count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
              count(user_name) AS known_users
       FROM events LEFT JOIN users USING (user_id) GROUP BY 1, 2""",
)
def staged_transforms(t):
    summary = Contract.from_dict(
        {
            "name": "event-summary",
            "schema": [
                {"name": "date"}, {"name": "event_type"}, {"name": "total_events", "type": "bigint"},
                {"name": "unique_users", "type": "bigint"}, {"name": "known_users", "type": "bigint"},
            ],
        }
    )

    def stage(x):
        return {"staged": x["raw"].select("event_type", "ts", "user_id")}

    def enrich(x):
        return {"enriched": E.enrich_events(x["staged"], x["users"])}

    def aggregate(x):
        grouped = x["enriched"].groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_type")
        return {
            "summary": grouped.agg(
                F.count(F.lit(1)).alias("total_events"), F.count_distinct("user_id").alias("unique_users"),
                F.count("user_name").alias("known_users"),
            )
        }

    result = run_stages({"raw": t.events, "users": t.users}, [stage, enrich, aggregate], {"summary": summary})
    return result["summary"]


PROFILED = {"user_id": "bigint", "event_id": "bigint", "ts": "timestamp_ntz", "event_type": "string", "value": "double", "props": "string",
            "user_name": "string", "user_email": "string"}


def profile_sql(name, kind):
    """A column's row of the profile; the sketches are held to their bounds against exact results."""
    sized = {"double": "double", "timestamp_ntz": "timestamp"}.get(kind, "plain")
    number = kind in ("bigint", "double")
    bounds = f"min({name}), max({name})" if kind in ("bigint", "string") else "NULL, NULL"
    least, greatest = (f"CAST({b} AS VARCHAR)" for b in bounds.split(", "))
    return f"""SELECT '{name}' AS column_name, '{kind}' AS type, count(*) AS row_count, count(*) - count({name}) AS nulls,
        (count(*) - count({name})) / CAST(count(*) AS DOUBLE) AS null_rate, CAST(coalesce(sum(strlen({text_sql(name, sized)})), 0) AS BIGINT) AS bytes,
        {least} AS least, {greatest} AS greatest, TRUE AS distinct_near, {'TRUE' if number else 'NULL::BOOLEAN'} AS median_near
        FROM events LEFT JOIN users USING (user_id)"""


@query("A18", " UNION ALL ".join(profile_sql(n, k) for n, k in PROFILED.items()))
def quality_profile(t):
    """All columns. Of the sketches the query returns whether they are within 5 % of the exact number of distinct
    values, and within 5 % of the rows of the middle one; least and greatest of times and fractions are left out,
    as engines write them differently."""
    enriched = written(E.enrich_events(t.events, t.users).select(*PROFILED), "enriched")
    found = column_profile(enriched)
    exact = enriched.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in PROFILED])
    listed = exact.select(F.explode(F.create_map(*[x for c in PROFILED for x in (F.lit(c), F.col(f"d_{c}"))])).alias("column_name", "distinct"))
    both = found.join(listed, "column_name")
    medians = {r["column_name"]: r["approx_median"] for r in found.where("approx_median IS NOT NULL").collect()}
    ranks = enriched.agg(*[(F.count_if(F.col(c) <= m) / F.count(c)).alias(c) for c, m in medians.items()]).first().asDict()
    middle = {c: abs(r - 0.5) <= 0.05 for c, r in ranks.items()}
    near = F.abs(F.col("approx_distinct") - F.col("distinct")) <= 0.05 * F.col("distinct")
    median = F.lit(None).cast("boolean")
    for c, good in middle.items():
        median = F.when(F.col("column_name") == c, good).otherwise(median)
    shown = F.col("type").isin("bigint", "string")
    return both.select(
        "column_name", "type", "row_count", "nulls", "null_rate", "bytes", F.when(shown, F.col("least")).alias("least"),
        F.when(shown, F.col("greatest")).alias("greatest"), near.alias("distinct_near"), median.alias("median_near"),
    )


@query(
    "L16",
    """SELECT * FROM (VALUES ('event_id', 'bigint', 'bigint', 'ok', 0::BIGINT), ('user_id', 'string', 'bigint', 'type_mismatch', 0),
                             ('email', 'string', NULL, 'missing', 0), ('ts', NULL, 'timestamp', 'extra', 0),
                             ('value', 'decimal', 'float', 'unknown_type', 0), ('props', NULL, 'string', 'extra', 0))
                     AS v(column_name, expected_type, actual_type, finding, uncastable_values)
       UNION ALL SELECT 'event_type', 'integer', 'string', 'type_mismatch',
                        count(*) FILTER (WHERE TRY_CAST(event_type AS INTEGER) IS NULL) FROM events""",
)
def contract_conformance(t):
    contract = Contract.from_dict(
        {
            "name": "events",
            "schema": [
                {"name": "event_id", "type": "bigint"}, {"name": "user_id", "type": "string"},
                {"name": "event_type", "type": "integer"}, {"name": "email"}, {"name": "value", "type": "decimal"},
            ],
        }
    )
    return conformance_report(t.events, contract)


@query(
    "L18",
    """SELECT event_id, event_type, CAST(NULL AS BIGINT) AS user_id FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
       UNION ALL SELECT event_id, event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""",
)
def additive_versions(t):
    split = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    old = t.events.filter(F.col("ts") < split).select("event_id", "event_type")
    new = t.events.filter(F.col("ts") >= split).select("event_id", "event_type", "user_id")
    return read_together(old, new)
