"""The database adoption report and its staging steps."""

from pyspark.sql import functions as F

from weirgate.operators import adoption as D
from weirgate.plans.registry import query

STATUS = """CASE lower(trim(status)) WHEN 'o' THEN 'pending' WHEN 'f' THEN 'failed' WHEN 'p' THEN 'deployed'
            WHEN '' THEN 'unknown' ELSE coalesce(lower(trim(status)), 'unknown') END"""
RELEASES = f"""rel AS (SELECT cluster, namespace, release_name, chart_name, chart_version, {STATUS} AS status, collected_at, row_id
  FROM helm_releases QUALIFY row_number() OVER (PARTITION BY cluster, namespace, release_name ORDER BY collected_at DESC, row_id DESC) = 1)"""
CLAIMS = f"""claims AS (SELECT cluster, namespace, claim_name, db_type, {STATUS} AS status, regexp_extract(claim_name, '^([a-z]+)', 1) AS instance_label
  FROM database_claims QUALIFY row_number() OVER (PARTITION BY cluster, namespace, claim_name ORDER BY collected_at DESC, row_id DESC) = 1)"""
INDICATORS = """ind AS (SELECT DISTINCT cluster, namespace, resource_name AS release_name, indicator_type, indicator_key
  FROM resource_keys WHERE indicator_key <> 'LOG_LEVEL')"""
REPORT = f"""{RELEASES}, {CLAIMS}, {INDICATORS},
  c AS (SELECT cluster, namespace, claim_name AS release_name, min(db_type) AS db_type FROM claims GROUP BY 1, 2, 3),
  i AS (SELECT cluster, namespace, release_name, string_agg(DISTINCT indicator_type, ',' ORDER BY indicator_type) AS indicator_types
        FROM ind GROUP BY 1, 2, 3),
  report AS (SELECT rel.cluster, rel.namespace, rel.release_name, rel.chart_name, c.db_type IS NOT NULL AS has_dbclaim,
                    i.indicator_types IS NOT NULL AS has_db_indicators, coalesce(i.indicator_types, '') AS indicator_types, c.db_type,
                    CASE WHEN c.db_type IS NOT NULL THEN 'managed' WHEN i.indicator_types IS NOT NULL THEN 'unmanaged' ELSE 'no-db' END AS assessment
             FROM rel LEFT JOIN c USING (cluster, namespace, release_name) LEFT JOIN i USING (cluster, namespace, release_name))"""


def staged(t):
    return D.stage_releases(t.helm_releases), D.stage_claims(t.database_claims), D.indicator_rows(t.resource_keys)


@query("F4", f"WITH {RELEASES} SELECT cluster, namespace, release_name, chart_name, status, collected_at FROM rel")
def newest_releases(t):
    columns = ["cluster", "namespace", "release_name", "chart_name", "status", "collected_at"]
    return D.stage_releases(t.helm_releases).select(*columns)


@query("P12", f"WITH {CLAIMS} SELECT cluster, namespace, claim_name, db_type, status, instance_label FROM claims")
def staged_claims(t):
    columns = ["cluster", "namespace", "claim_name", "db_type", "status", "instance_label"]
    return D.stage_claims(t.database_claims).select(*columns)


@query(
    "P13",
    """SELECT release_name, row_id, chart_name, chart_version,
              CASE WHEN row_id % 2 = 0 THEN concat('app-', status) END AS app_version FROM helm_releases""",
)
def chart_metadata(t):
    chart = F.struct(
        F.col("chart_name").alias("name"), F.col("chart_version").alias("version"),
        F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("app-"), F.col("status"))).alias("appVersion"),
    )
    packed = t.helm_releases.select("release_name", "row_id", F.to_json(F.struct(chart.alias("chart"))).alias("values_json"))
    return D.chart_values(packed)


@query(
    "P14",
    """SELECT cluster, namespace, resource_name AS release_name, indicator_type, indicator_key FROM resource_keys WHERE indicator_key <> 'LOG_LEVEL'""",
)
def database_signals(t):
    entry = F.create_map("indicator_key", F.lit("x"), F.lit("OTHER"), F.lit("debug"))
    resources = t.resource_keys.withColumn("data_keys_json", F.to_json(entry))
    return D.indicators_from_json(resources, "data_keys_json", F.col("indicator_type"))


@query(
    "P14",
    """SELECT source, count(*) AS documents,
              count(*) FILTER (WHERE regexp_matches(text, 'DATABASE_URL|PGHOST|DB_HOST|jdbc:')) AS with_signal
       FROM documents GROUP BY source""",
)
def document_signals(t):
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(D.signal(F.col("text"))).alias("with_signal")
    )


@query(
    "A16",
    f"WITH {INDICATORS} SELECT cluster, namespace, release_name, string_agg(DISTINCT indicator_type, ',' ORDER BY indicator_type) AS indicator_types FROM ind GROUP BY 1, 2, 3",
)
def indicator_types(t):
    return D.indicator_types(D.indicator_rows(t.resource_keys))


@query("J2 P15", f"WITH {REPORT} SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS updated_at FROM report")
def adoption_report(t):
    return D.adoption_report(*staged(t), updated_at=F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("J3", f"WITH {REPORT} SELECT cluster, namespace, release_name, chart_name FROM report WHERE has_dbclaim")
def releases_with_claim(t):
    releases, claims, _ = staged(t)
    return D.releases_with_claim(releases, claims).select("cluster", "namespace", "release_name", "chart_name")


@query("J4", f"WITH {REPORT} SELECT cluster, namespace, release_name, chart_name FROM report WHERE assessment = 'unmanaged'")
def releases_with_signals_only(t):
    return D.releases_with_signals_only(*staged(t)).select("cluster", "namespace", "release_name", "chart_name")


POSTURE = """SELECT cluster, namespace, CAST(grouping(cluster) * 2 + grouping(namespace) AS BIGINT) AS level, count(*) AS releases,
       count(*) FILTER (WHERE assessment = 'managed') AS managed, count(*) FILTER (WHERE assessment = 'unmanaged') AS unmanaged,
       count(*) FILTER (WHERE assessment = 'no-db') AS no_db FROM report GROUP BY """


@query("A17", f"WITH {REPORT} {POSTURE} ROLLUP (cluster, namespace)")
def adoption_posture(t):
    return D.posture(D.adoption_report(*staged(t)))


@query("A17", f"WITH {REPORT} {POSTURE} CUBE (cluster, namespace)")
def adoption_posture_cube(t):
    return D.posture(D.adoption_report(*staged(t)), every_combination=True)
