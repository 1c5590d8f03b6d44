"""Lineage graphs, events and columns."""

from pyspark.sql import functions as F

from weirgate.operators import graph as G
from weirgate.operators import lineage as L
from weirgate.plans.registry import query

TARGET = "ds-144"
SOURCE = "ds-4"
UP = f"""WITH RECURSIVE up(id) AS (SELECT '{TARGET}' UNION SELECT src FROM flow_edges JOIN up ON dst = id)"""


def reach_sql(seed, near, far, name, limit=""):
    return f"""{name}(id, depth) AS (SELECT '{seed}', 0 UNION SELECT {far}, depth + 1 FROM edges JOIN {name} ON {near} = id {limit})"""


@query("L1", f"{UP} SELECT up.id, coalesce(n.type, 'dataset') AS type FROM up LEFT JOIN flow_nodes n ON n.id = up.id")
def upstream_nodes(t):
    return G.upstream_nodes(t.flow_edges, t.flow_nodes, TARGET).select("id", "type")


@query("L1", f"{UP} SELECT src, dst FROM flow_edges WHERE src IN (SELECT id FROM up) AND dst IN (SELECT id FROM up)")
def upstream_edges(t):
    edges = t.flow_edges
    return G.edges_within(edges, G.upstream_nodes(edges, t.flow_nodes, TARGET))


@query(
    "L2",
    f"""WITH RECURSIVE {reach_sql('ds-12', 'dst', 'src', 'u', 'WHERE depth < 3')}, {reach_sql('ds-12', 'src', 'dst', 'd', 'WHERE depth < 3')}
        SELECT id AS node, CAST(min(depth) AS INTEGER) AS depth, CASE WHEN min(depth) = 0 THEN 'root' ELSE 'upstream' END AS direction FROM u GROUP BY id
        UNION ALL SELECT id, CAST(min(depth) AS INTEGER), 'downstream' FROM d GROUP BY id HAVING min(depth) > 0""",
)
def lineage_around(t):
    return G.lineage_around(t.edges, "ds-12", depth=3)


IMPACT = f"""WITH RECURSIVE {reach_sql(SOURCE, 'src', 'dst', 'd')},
    found AS (SELECT id AS node, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY id HAVING min(depth) > 0),
    consumers AS (SELECT node, depth, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS consumer FROM found)"""


@query("L3", f"{IMPACT} SELECT node, depth, consumer FROM consumers")
def impact(t):
    return G.impact(t.edges, SOURCE)


@query("L3", f"{IMPACT} SELECT consumer, count(*) AS consumers FROM consumers GROUP BY consumer")
def impact_counts(t):
    return G.impact_counts(G.impact(t.edges, SOURCE))


DEPS = """transforms AS (SELECT id FROM flow_nodes WHERE type = 'transform'),
  prod AS (SELECT dst AS dataset, arg_max(src, ("position", src)) AS producer, count(*) AS writers FROM flow_edges
           WHERE src IN (SELECT id FROM transforms) GROUP BY dst),
  deps AS (SELECT DISTINCT e.dst AS transform, p.producer AS depends_on FROM flow_edges e JOIN prod p ON e.src = p.dataset
           WHERE e.dst IN (SELECT id FROM transforms) AND e.dst <> p.producer)"""


@query("J5", f"WITH {DEPS} SELECT transform, depends_on FROM deps")
def transform_dependencies(t):
    return G.transform_dependencies(t.flow_nodes, t.flow_edges)


@query("J5", f"WITH {DEPS} SELECT dataset, producer, writers FROM prod")
def dataset_producers(t):
    return G.producers(t.flow_nodes, t.flow_edges)


@query(
    "L8",
    f"""WITH RECURSIVE {DEPS},
        lv(transform, level) AS (SELECT id, 0 FROM transforms UNION SELECT d.transform, level + 1 FROM lv JOIN deps d ON d.depends_on = lv.transform)
        SELECT transform, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY transform""",
)
def dependency_levels(t):
    return G.dependency_levels(t.flow_nodes, t.flow_edges)


@query("J6", "SELECT id, type FROM flow_nodes WHERE type = 'dataset' AND id NOT IN (SELECT dst FROM flow_edges)")
def root_datasets(t):
    return G.roots(t.flow_nodes, t.flow_edges).select("id", "type")


@query(
    "A20",
    """SELECT n.id, (SELECT count(*) FROM flow_edges e WHERE e.dst = n.id) AS inputs, (SELECT count(*) FROM flow_edges e WHERE e.src = n.id) AS outputs
       FROM flow_nodes n WHERE type = 'transform'""",
)
def transform_ports(t):
    return G.transform_ports(t.flow_nodes, t.flow_edges)


@query("G3", "SELECT id, type FROM flow_nodes ORDER BY type, id")
def ordered_nodes(t):
    return G.ordered_nodes(t.flow_nodes).select("id", "type")


@query(
    "L9",
    """SELECT concat('in-', user_id % 20) AS src, concat('job-', user_id) AS dst FROM events
       UNION SELECT concat('ref-', user_id % 7), concat('job-', user_id) FROM events
       UNION SELECT concat('job-', user_id), concat('out-', user_id) FROM events""",
)
def event_graph(t):
    return L.graph_edges(t.nested_events)


@query(
    "L10",
    """SELECT concat('run-', event_id) AS run_id, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'COMPLETE' END AS "eventType",
              CASE WHEN event_type = 'error' THEN concat('failed at ', CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)) END AS error_message,
              concat('parent-', user_id) AS parent_run_id,
              CAST(floor((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS delay_seconds,
              CAST(floor(value) AS BIGINT) AS rows_written FROM events""",
)
def run_facets(t):
    return L.run_facets(t.nested_events)


@query(
    "L10",
    """SELECT concat('out-', user_id) AS dataset, 'user_id' AS name, 'bigint' AS type FROM events
       UNION SELECT concat('out-', user_id), event_type, 'float' FROM events""",
)
def facet_schemas(t):
    return L.schema_fields(t.nested_events)


def lifecycle_sql(as_of):
    """Run rows as of an instant, an SQL expression."""
    return f"""SELECT run_id, job_name, start_time, end_time, status,
              CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / CAST(1000 AS DOUBLE)) AS BIGINT) AS duration_ms FROM (
         SELECT run_id, job_name, min(event_time) FILTER (WHERE event_type = 'START') AS start_time,
                max(event_time) FILTER (WHERE event_type <> 'START') AS end_time,
                CASE max(event_type) FILTER (WHERE event_type <> 'START') WHEN 'COMPLETE' THEN 'success' WHEN 'FAIL' THEN 'failure'
                     WHEN 'ABORT' THEN 'cancelled'
                     ELSE CASE WHEN min(event_time) < {as_of} - INTERVAL '1' HOUR THEN 'stale' ELSE 'running' END END AS status
         FROM lineage_events GROUP BY run_id, job_name)"""


@query("T6", lifecycle_sql("TIMESTAMP '2024-01-20 00:00:00'"))
def run_lifecycle(t):
    return L.run_lifecycle(t.lineage_events, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), timeout_seconds=3600)


@query(
    "F7",
    """WITH beats AS (SELECT DISTINCT run_id, event_time FROM heartbeats),
            gaps AS (SELECT *, lag(event_time) OVER (PARTITION BY run_id ORDER BY event_time) AS previous_time FROM beats)
       SELECT run_id, event_time, previous_time, (epoch_us(event_time) - epoch_us(previous_time)) / CAST(1000000 AS DOUBLE) AS gap_seconds,
              coalesce((epoch_us(event_time) - epoch_us(previous_time)) / CAST(1000000 AS DOUBLE) > 7200, false) AS missed
       FROM gaps""",
)
def heartbeat_gaps(t):
    return L.heartbeat_gaps(t.heartbeats, interval_seconds=3600, allowed=2.0)


COLUMN_EDGES = """ce AS (SELECT regexp_extract(from_ref, '^(.*)\\.([^.]*)$', 1) AS src_dataset, regexp_extract(from_ref, '^(.*)\\.([^.]*)$', 2) AS src_column,
                         dataset AS dst_dataset, name AS dst_column FROM fields WHERE from_ref IS NOT NULL),
  ids AS (SELECT DISTINCT concat(src_dataset, '.', src_column) AS s, concat(dst_dataset, '.', dst_column) AS d FROM ce)"""


@query("L4", f"WITH {COLUMN_EDGES} SELECT * FROM ce")
def column_edges(t):
    return L.column_edges(t.fields)


@query(
    "L5",
    f"""WITH RECURSIVE {COLUMN_EDGES},
        up(node, depth) AS (SELECT 'ds-192.email', 0 UNION SELECT s, depth + 1 FROM ids JOIN up ON d = node)
        SELECT node AS origin, CAST(min(depth) AS INTEGER) AS depth FROM up WHERE node NOT IN (SELECT d FROM ids) GROUP BY node""",
)
def column_origins(t):
    return L.column_origins(t.fields, "ds-192.email")


PII = f"""WITH RECURSIVE {COLUMN_EDGES},
    flagged AS (SELECT concat(dataset, '.', name) AS node, dataset, bool_or(pii) AS pii FROM fields GROUP BY 1, 2),
    below(node) AS (SELECT d FROM ids JOIN flagged ON s = node WHERE pii UNION SELECT d FROM ids JOIN below ON s = node),
    flow AS (SELECT node AS column_id, dataset, pii AS marked FROM below JOIN flagged USING (node))"""


@query("L6", f"{PII} SELECT * FROM flow")
def pii_flow(t):
    return L.pii_flow(t.fields)


@query(
    "L6",
    f"""{PII} SELECT count(DISTINCT dataset) AS affected_datasets, count(*) AS affected_columns, count(*) FILTER (WHERE NOT marked) AS unmarked_columns FROM flow""",
)
def pii_flow_counts(t):
    return L.pii_flow_counts(L.pii_flow(t.fields))
