"""Run, catalog, graph and report tables derived from the given tables.

Most derivations are one SQL text that Spark and DuckDB both run: ``{events}`` and the like stand for the
input tables. The few that need an array function differ between the two and are given twice.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.session import written

RUNS = """
SELECT concat('run-', CAST(event_id AS STRING)) AS id,
       concat('pkg-', CAST(user_id % 50 AS STRING)) AS package,
       concat('team-', CAST(user_id % 3 AS STRING)) AS namespace,
       concat('1.', CAST(event_id % 4 AS STRING), '.0') AS version,
       CASE event_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'int' ELSE 'prod' END AS environment,
       CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'running'
                       WHEN 'click' THEN 'cancelled' ELSE 'success' END AS status,
       ts AS start_time,
       CASE WHEN event_type = 'signup' THEN NULL
            ELSE ts + CAST(floor(value) AS INT) * INTERVAL '1' SECOND END AS end_time,
       CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value) AS BIGINT) * 1000 END AS duration_ms,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS records_processed
FROM {events}"""

HELM_RELEASES = """
SELECT concat('c', CAST(o_custkey % 3 AS STRING)) AS cluster,
       concat('ns', CAST(o_custkey % 10 AS STRING)) AS namespace,
       concat('rel', CAST(o_orderkey % 500 AS STRING)) AS release_name,
       concat('chart-', CAST(o_orderkey % 9 AS STRING)) AS chart_name,
       concat('1.', CAST(o_orderkey % 7 AS STRING), '.0') AS chart_version,
       o_orderstatus AS status, o_orderdate AS collected_at, o_orderkey AS row_id
FROM {orders}"""

DATABASE_CLAIMS = """
SELECT concat('c', CAST(o_custkey % 3 AS STRING)) AS cluster,
       concat('ns', CAST(o_custkey % 10 AS STRING)) AS namespace,
       concat('rel', CAST(o_orderkey % 500 AS STRING)) AS claim_name,
       CASE o_orderkey % 2 WHEN 0 THEN 'postgres' ELSE 'mysql' END AS db_type,
       o_orderstatus AS status, o_orderdate AS collected_at, o_orderkey AS row_id
FROM {orders} WHERE o_orderpriority = '1-URGENT'"""

RESOURCE_KEYS = """
SELECT concat('c', CAST(o_custkey % 3 AS STRING)) AS cluster,
       concat('ns', CAST(o_custkey % 10 AS STRING)) AS namespace,
       concat('rel', CAST(o_orderkey % 500 AS STRING)) AS resource_name,
       CASE l_linenumber % 3 WHEN 0 THEN 'configmap' WHEN 1 THEN 'secret' ELSE 'env' END AS indicator_type,
       CASE l_partkey % 6 WHEN 0 THEN 'DATABASE_URL' WHEN 1 THEN 'PGHOST' WHEN 2 THEN 'DB_HOST'
                          WHEN 3 THEN 'jdbc:postgresql' ELSE 'LOG_LEVEL' END AS indicator_key
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

CATALOG = """
SELECT concat('ds-', CAST(p_partkey AS STRING)) AS name,
       concat('team-', CAST(p_partkey % 5 AS STRING)) AS namespace,
       CASE p_partkey % 3 WHEN 0 THEN 'job' ELSE 'dataset' END AS type,
       CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 4 = 3 THEN 'Own@example.org'
            WHEN p_partkey % 4 = 2 THEN 'data-team@example.com' ELSE 'core@example.com' END AS owner,
       CASE p_size % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential'
                       WHEN 3 THEN 'restricted' ELSE NULL END AS classification,
       p_partkey % 4 = 0 AS pii,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size * 30 END AS retention_days,
       concat(CAST(p_size % 3 AS STRING), '.', CAST(p_size % 12 AS STRING), '.', CAST(p_partkey % 4 AS STRING)) AS version,
       concat('tier-', CAST(p_size % 3 AS STRING), ',', lower(p_brand),
              CASE WHEN p_partkey % 7 = 0 THEN ',gdpr' ELSE '' END) AS tags_csv,
       p_name AS description,
       TIMESTAMP '2024-01-01 00:00:00' + (p_partkey % 700) * INTERVAL '1' DAY AS updated_at,
       concat('id-', CAST(p_partkey AS STRING)) AS record_id
FROM {part}"""

LINEAGE_EVENTS = """
SELECT concat('run-', CAST(event_id AS STRING)) AS run_id, 'START' AS event_type, ts AS event_time,
       concat('pkg-', CAST(user_id % 50 AS STRING)) AS job_name FROM {events}
UNION ALL
SELECT concat('run-', CAST(event_id AS STRING)),
       CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'ABORT' ELSE 'COMPLETE' END,
       ts + CAST(floor(value) AS INT) * INTERVAL '1' SECOND,
       concat('pkg-', CAST(user_id % 50 AS STRING)) FROM {events} WHERE event_type <> 'signup'"""

HEARTBEATS = """
SELECT concat('run-', CAST(user_id AS STRING)) AS run_id, ts AS event_time FROM {events}"""

PROMOTIONS = """
SELECT concat('promo-', CAST(event_id AS STRING)) AS id,
       concat('pkg-', CAST(user_id % 50 AS STRING)) AS package,
       concat('1.', CAST(event_id % 4 AS STRING), '.', CAST(event_id % 10 AS STRING)) AS version,
       CASE event_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'int' ELSE 'prod' END AS to_env,
       ts AS promoted_at, concat('user-', CAST(user_id AS STRING)) AS initiated_by
FROM {events} WHERE event_type IN ('purchase', 'click')"""

LOGS = """
SELECT ts AS "timestamp", CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
       concat(event_type, ' ', props) AS msg,
       concat('run-', CAST(event_id AS STRING)) AS run_id,
       concat('pkg-', CAST(user_id % 50 AS STRING)) AS package
FROM {events}"""

USERS = """
SELECT c_custkey AS user_id, c_name AS user_name,
       concat('user', CAST(c_custkey AS STRING), '@example.com') AS user_email
FROM {customer} WHERE c_mktsegment <> 'MACHINERY'"""

SCHEMA_REFS = """
SELECT concat('ds-', CAST(p_partkey AS STRING)) AS dataset, p_partkey AS "position",
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN lower(p_type)
            ELSE concat(lower(p_type), '-', CAST(p_size AS STRING), '@^', CAST(p_size % 4 AS STRING), '.1.0') END AS schema_ref
FROM {part}"""

SHARED = {
    "runs": RUNS,
    "helm_releases": HELM_RELEASES,
    "database_claims": DATABASE_CLAIMS,
    "resource_keys": RESOURCE_KEYS,
    "catalog_csv": CATALOG,
    "lineage_events": LINEAGE_EVENTS,
    "heartbeats": HEARTBEATS,
    "promotions": PROMOTIONS,
    "logs": LOGS,
    "users": USERS,
    "schema_refs": SCHEMA_REFS,
}

# DuckDB texts of the derivations that use array functions; each may use those before it.
DUCKDB_ONLY = {
    "catalog": "SELECT *, string_split(tags_csv, ',') AS tags FROM catalog_csv",
    "edges": """
SELECT concat('ds-', p_partkey) AS src, concat('ds-', p_partkey * k) AS dst
FROM (SELECT p_partkey, unnest([2, 3]) AS k FROM part)
WHERE p_partkey > 0 AND p_partkey * k <= (SELECT max(p_partkey) FROM part)""",
    "flow_edges": """
SELECT DISTINCT src, dst, "position" FROM (
  SELECT concat('ds-', p_partkey) AS src, concat('tf-', p_partkey * k) AS dst, p_partkey * k * 2 AS "position"
  FROM (SELECT p_partkey, unnest([2, 3]) AS k FROM part)
  WHERE p_partkey > 0 AND p_partkey * k <= (SELECT max(p_partkey) FROM part)
  UNION ALL
  SELECT concat('tf-', p_partkey * k), concat('ds-', p_partkey * k), p_partkey * k * 2
  FROM (SELECT p_partkey, unnest([2, 3]) AS k FROM part)
  WHERE p_partkey > 0 AND p_partkey * k <= (SELECT max(p_partkey) FROM part)
  UNION ALL
  SELECT concat('ds-', p_partkey // 10), concat('alt-', p_partkey), p_partkey * 2 + 1
  FROM part WHERE p_brand = 'Brand#2' AND p_partkey > 0
  UNION ALL
  SELECT concat('alt-', p_partkey), concat('ds-', p_partkey), p_partkey * 2 + 1
  FROM part WHERE p_brand = 'Brand#2' AND p_partkey > 0)""",
    "flow_nodes": """
SELECT id, CASE WHEN id LIKE 'ds-%' THEN 'dataset' ELSE 'transform' END AS type
FROM (SELECT src AS id FROM flow_edges UNION SELECT dst FROM flow_edges
      UNION SELECT concat('ds-', p_partkey) FROM part)""",
    "fields": """
SELECT concat('ds-', p_partkey) AS dataset, f.i AS "position",
       CASE WHEN f.i = 3 AND p_size = 50 THEN '' WHEN f.i = 3 THEN 'email' ELSE f.n END AS name,
       CASE WHEN f.i = 0 AND p_size % 2 = 0 THEN 'bigint' ELSE f.t END AS type,
       f.n = 'email' AND (p_partkey % 2 = 1 OR p_partkey % 8 = 0) AS pii,
       CASE WHEN p_partkey = 0 OR f.i = 3 THEN NULL
            WHEN p_partkey % 2 = 0 THEN concat('ds-', p_partkey // 2, '.', f.n)
            WHEN p_partkey % 3 = 0 THEN concat('ds-', p_partkey // 3, '.', f.n) END AS from_ref
FROM (SELECT p_partkey, p_size, unnest([{{'i': 0, 'n': 'key', 't': 'integer'}}, {{'i': 1, 'n': 'email', 't': 'string'}},
      {{'i': 2, 'n': 'amount', 't': 'float'}}, {{'i': 3, 'n': 'copy', 't': 'string'}}]) AS f FROM part)
WHERE f.i < 3 OR p_size > 45""",
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_PLACEHOLDER = re.compile(r"\{(\w+)\}")


class Tables:
    """The given tables of one folder and everything derived from them, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in SHARED:
            inputs = {n: getattr(self, n) for n in set(_PLACEHOLDER.findall(SHARED[name]))}
            return self.spark.sql(SHARED[name].replace('"', "`"), **inputs)
        raise AttributeError(name)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    @property
    def catalog(self) -> DataFrame:
        updated = F.col("updated_at").cast("timestamp_ntz")
        return self.catalog_csv.withColumn("tags", F.split("tags_csv", ",")).withColumn("updated_at", updated)

    def _doubled(self) -> DataFrame:
        part = self.part.select("p_partkey")
        last = part.agg(F.max("p_partkey")).scalar()
        return (
            part.filter("p_partkey > 0")
            .withColumn("k", F.explode(F.array(F.lit(2), F.lit(3))))
            .withColumn("next", F.col("p_partkey") * F.col("k"))
            .filter(F.col("next") <= last)
        )

    @property
    def edges(self) -> DataFrame:
        return self._doubled().select(_id("ds", "p_partkey").alias("src"), _id("ds", "next").alias("dst"))

    @cached_property
    def flow_edges(self) -> DataFrame:
        """Datasets and the transforms between them, stored like any graph the operators would be given."""
        near = self._doubled().withColumn("position", F.col("next") * 2)
        usual = near.select(
            F.inline(
                F.array(
                    F.struct(_id("ds", "p_partkey").alias("src"), _id("tf", "next").alias("dst"), "position"),
                    F.struct(_id("tf", "next").alias("src"), _id("ds", "next").alias("dst"), "position"),
                )
            )
        )
        tens = self.part.filter("p_brand = 'Brand#2' AND p_partkey > 0").select("p_partkey")
        tens = tens.withColumn("tenth", F.expr("p_partkey div 10")).withColumn("position", F.col("p_partkey") * 2 + 1)
        other = tens.select(
            F.inline(
                F.array(
                    F.struct(_id("ds", "tenth").alias("src"), _id("alt", "p_partkey").alias("dst"), "position"),
                    F.struct(_id("alt", "p_partkey").alias("src"), _id("ds", "p_partkey").alias("dst"), "position"),
                )
            )
        )
        return written(usual.unionByName(other).distinct(), "graph")

    @cached_property
    def flow_nodes(self) -> DataFrame:
        edges = self.flow_edges
        ids = (
            edges.select(F.explode(F.array("src", "dst")).alias("id"))
            .unionByName(self.part.select(_id("ds", "p_partkey").alias("id")))
            .distinct()
        )
        nodes = ids.withColumn("type", F.when(F.col("id").startswith("ds-"), "dataset").otherwise("transform"))
        return written(nodes, "graph")

    @property
    def fields(self) -> DataFrame:
        declared = [(0, "key", "integer"), (1, "email", "string"), (2, "amount", "float"), (3, "copy", "string")]
        every = F.array(
            *[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(t).alias("t")) for i, n, t in declared]
        )
        rows = self.part.select("p_partkey", "p_size", F.explode(every).alias("f")).filter("f.i < 3 OR p_size > 45")
        return rows.select(
            _id("ds", "p_partkey").alias("dataset"),
            F.col("f.i").alias("position"),
            F.expr("CASE WHEN f.i = 3 AND p_size = 50 THEN '' WHEN f.i = 3 THEN 'email' ELSE f.n END").alias("name"),
            F.expr("CASE WHEN f.i = 0 AND p_size % 2 = 0 THEN 'bigint' ELSE f.t END").alias("type"),
            F.expr("f.n = 'email' AND (p_partkey % 2 = 1 OR p_partkey % 8 = 0)").alias("pii"),
            F.expr(
                "CASE WHEN p_partkey = 0 OR f.i = 3 THEN NULL"
                " WHEN p_partkey % 2 = 0 THEN concat('ds-', p_partkey div 2, '.', f.n)"
                " WHEN p_partkey % 3 = 0 THEN concat('ds-', p_partkey div 3, '.', f.n) END"
            ).alias("from_ref"),
        )

    @property
    def nested_events(self) -> DataFrame:
        """Lineage events in their nested form: one COMPLETE or FAIL event per event row, with facets."""
        job = F.struct(F.lit("jobs").alias("namespace"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("name"))
        run_id = F.concat(F.lit("run-"), F.col("event_id").cast("string"))
        nominal = F.to_json(F.struct(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("nominalStartTime")))
        failed = F.to_json(F.struct(F.concat(F.lit("failed at "), F.col("value").cast("decimal(10,2)").cast("string")).alias("message")))
        parent = F.to_json(F.struct(F.struct(F.concat(F.lit("parent-"), F.col("user_id").cast("string")).alias("runId")).alias("run")))
        facets = F.map_filter(
            F.create_map(
                F.lit("nominalTime"), nominal, F.lit("errorMessage"), F.when(F.col("event_type") == "error", failed),
                F.lit("parent"), parent,
            ),
            lambda _, v: v.isNotNull(),
        )
        quality = F.to_json(F.struct(F.floor("value").alias("rowCount")))
        columns = F.to_json(
            F.struct(
                F.array(
                    F.struct(F.lit("user_id").alias("name"), F.lit("bigint").alias("type")),
                    F.struct(F.col("event_type").alias("name"), F.lit("float").alias("type")),
                ).alias("fields")
            )
        )

        def dataset(prefix: str, key, facet_map):
            return F.struct(F.lit("data").alias("namespace"), F.concat(F.lit(prefix), key.cast("string")).alias("name"), facet_map.alias("facets"))

        none = F.create_map().cast("map<string,string>")
        return self.events.select(
            F.col("ts").alias("eventTime"),
            F.when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE").alias("eventType"),
            F.struct(run_id.alias("runId"), facets.alias("facets")).alias("run"),
            job.alias("job"),
            F.array(dataset("in-", F.col("user_id") % 20, none), dataset("ref-", F.col("user_id") % 7, none)).alias("inputs"),
            F.array(dataset("out-", F.col("user_id"), F.create_map(F.lit("dataQualityMetrics"), quality, F.lit("schema"), columns))).alias("outputs"),
        )


def _id(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}-"), F.col(key).cast("string"))


_NEEDS = {
    "catalog": ("catalog_csv",),
    "flow_nodes": ("flow_edges",),
}


def oracle(text: str) -> str:
    """DuckDB query whose common table expressions hold the derived tables the text mentions."""
    names: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in names:
            names.append(name)

    for name in (*SHARED, *DUCKDB_ONLY):
        if re.search(rf"\b{name}\b", text):
            add(name)
    parts = []
    for name in names:
        body = SHARED[name] if name in SHARED else DUCKDB_ONLY[name].replace("{{", "{").replace("}}", "}")
        parts.append(f"{name} AS ({_PLACEHOLDER.sub(lambda m: m[1], body) if name in SHARED else body})")
    stripped = text.strip()
    if not parts:
        return stripped
    head = "WITH RECURSIVE "
    if stripped.upper().startswith("WITH RECURSIVE"):
        return head + ",\n".join(parts) + ",\n" + stripped[len("WITH RECURSIVE"):].lstrip()
    if stripped.upper().startswith("WITH"):
        return head + ",\n".join(parts) + ",\n" + stripped[len("WITH"):].lstrip()
    return head + ",\n".join(parts) + "\n" + stripped
