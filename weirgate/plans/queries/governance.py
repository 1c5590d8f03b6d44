"""Governance, retention and fingerprints."""

from datetime import date

from pyspark.sql import functions as F

from weirgate.operators import governance as V
from weirgate.operators.fingerprint import fingerprints, table_fingerprint, verify
from weirgate.plans.digests import CUSTOMER, ORDERS, digest_sql, row_sql
from weirgate.plans.queries.writes import versioned
from weirgate.plans.registry import query
from weirgate.session import written
from weirgate.sources.versions import retain, retain_days

AS_OF = "2025-06-01"
RANK = "CASE {c} WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 END"
FLOWS = f"""flows AS (SELECT e.src, e.dst, s.namespace AS src_namespace, d.namespace AS dst_namespace, s.namespace <> d.namespace AS crosses_namespace,
         coalesce({RANK.format(c='d.classification')} < {RANK.format(c='s.classification')}, false) AS lowers_classification
  FROM edges e JOIN catalog s ON s.name = e.src JOIN catalog d ON d.name = e.dst)"""


@query(
    "A19",
    f"""WITH {FLOWS}, crossing AS (SELECT src_namespace AS namespace, count(*) AS cross_boundary_flows FROM flows
                                   WHERE crosses_namespace OR lowers_classification GROUP BY 1)
        SELECT namespace, count(*) AS packages, count(*) FILTER (WHERE pii) AS with_pii,
               count(*) FILTER (WHERE classification = 'public') AS public, count(*) FILTER (WHERE classification = 'internal') AS internal,
               count(*) FILTER (WHERE classification = 'confidential') AS confidential, count(*) FILTER (WHERE classification = 'restricted') AS restricted,
               CAST(count(classification) AS DOUBLE) / count(*) * 100 AS classification_pct,
               CAST(count(retention_days) AS DOUBLE) / count(*) * 100 AS retention_pct,
               CAST(count(owner) AS DOUBLE) / count(*) * 100 AS owner_pct, coalesce(max(cross_boundary_flows), 0) AS cross_boundary_flows
        FROM catalog LEFT JOIN crossing USING (namespace) GROUP BY namespace""",
)
def governance_report(t):
    records = t.catalog
    return V.governance_report(records, V.cross_boundary(t.edges, records))


@query(
    "A19",
    """SELECT namespace, count(*) FILTER (WHERE name NOT IN (SELECT dst FROM edges)) AS pii_sources,
              count(*) FILTER (WHERE name NOT IN (SELECT src FROM edges)) AS pii_sinks FROM catalog WHERE pii GROUP BY namespace""",
)
def pii_sources_and_sinks(t):
    return V.pii_ends(t.catalog, t.edges)


@query("L7", f"WITH {FLOWS} SELECT * FROM flows WHERE crosses_namespace OR lowers_classification")
def cross_boundary_flows(t):
    return V.cross_boundary(t.edges, t.catalog)


@query(
    "L15",
    """SELECT namespace, name, 'classification_required_for_pii' AS rule FROM catalog WHERE pii AND classification IS NULL
       UNION ALL SELECT namespace, name, 'owner_required' FROM catalog WHERE owner IS NULL
       UNION ALL SELECT namespace, name, 'owner_pattern' FROM catalog WHERE owner IS NOT NULL AND NOT regexp_full_match(owner, '[a-z-]+@example[.]com')
       UNION ALL SELECT namespace, name, 'pii_retention_too_long' FROM catalog WHERE pii AND retention_days > 730
       UNION ALL SELECT namespace, name, 'retention_required' FROM catalog WHERE classification IN ('confidential', 'restricted') AND retention_days IS NULL
       UNION ALL SELECT namespace, name, 'required_tags' FROM catalog WHERE classification = 'confidential' AND NOT list_contains(tags, 'gdpr')""",
)
def policy_violations(t):
    return V.policy_violations(t.catalog)


def as_of():
    return F.lit(AS_OF).cast("date")


@query(
    "L13",
    f"""SELECT namespace, name, days_remaining, CASE WHEN days_remaining < 0 THEN 'overdue' WHEN days_remaining <= 30 THEN 'approaching' ELSE 'ok' END AS retention_state
        FROM (SELECT namespace, name, CAST(retention_days - date_diff('day', CAST(updated_at AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_remaining
              FROM catalog WHERE retention_days IS NOT NULL)""",
)
def retention_status(t):
    return V.retention_status(t.catalog, as_of()).select("namespace", "name", "days_remaining", "retention_state")


def _stored(t):
    table = versioned(t, "orders")
    table.replace(t.orders, "load")
    return table


def retention_date():
    return F.lit("1999-01-01").cast("date")


@query(
    "L14",
    """SELECT *, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') <= 730 THEN 'kept' ELSE 'archive' END AS place FROM orders""",
)
def retention_archive(t):
    table, archive = _stored(t), versioned(t, "archive")
    for _ in range(2):  # the repeated run neither archives twice nor loses anything
        retain(table, "o_orderdate", 730, retention_date(), "nightly", "archive", archive)
    kept = table.read().withColumn("place", F.lit("kept"))
    return kept.unionByName(archive.read().withColumn("place", F.lit("archive")))


@query("L14", "SELECT * FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') <= 730")
def retention_delete(t):
    table = _stored(t)
    retain(table, "o_orderdate", 730, retention_date(), "nightly")
    return table.read()


@query("L14", "SELECT *, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%d') < '2024-01-11' AS archived FROM events")
def retention_by_day(t):
    table, archive = versioned(t, "days", "date"), versioned(t, "archive", "date")
    table.replace(t.events.withColumn("date", F.date_format("ts", "yyyy-MM-dd")), "load")
    for _ in range(2):
        retain_days(table, 20, date(2024, 1, 31), "nightly", "archive", archive)
    return table.read().withColumn("archived", F.lit(False)).unionByName(archive.read().withColumn("archived", F.lit(True)))


SALT = "concat('table=customer', chr(10), 'profile=default', chr(10))"


@query("A21", f"WITH {digest_sql(f'SELECT {row_sql(CUSTOMER)} AS txt FROM customer', salt=SALT)} SELECT row_count, fingerprint FROM prints")
def table_fingerprints(t):
    return table_fingerprint(t.customer, "customer")


ORDER_VALUES = {name: kind for name, kind in ORDERS.items() if name != "o_orderstatus"}


@query(
    "A22",
    f"""WITH {digest_sql(f'SELECT o_orderstatus, {row_sql(ORDER_VALUES)} AS txt FROM orders', keys='o_orderstatus')}
        SELECT o_orderstatus, fingerprint AS actual, CASE WHEN o_orderstatus = 'P' THEN 'sha256:stale' ELSE fingerprint END AS expected,
               o_orderstatus <> 'P' AS matches FROM prints""",
)
def verified_fingerprints(t):
    actual = written(fingerprints(t.orders, ["o_orderstatus"]), "fingerprints")
    noted = F.when(F.col("o_orderstatus") == "P", "sha256:stale").otherwise(F.col("fingerprint"))
    return verify(actual, actual.withColumn("fingerprint", noted), ["o_orderstatus"])
