"""Catalog search, references, locks and schema versions."""

from pyspark.sql import functions as F

from weirgate.contracts import Contract, duplicate_fields, schema_diff
from weirgate.operators import catalog as C
from weirgate.plans.registry import query
from weirgate.sources.keyed import upsert


@query(
    "P8",
    """SELECT name, namespace, owner, description FROM catalog
       WHERE type = 'dataset' AND owner = 'core@example.com' AND (contains(name, 'ring') OR contains(description, 'ring'))""",
)
def catalog_search(t):
    return C.search(t.catalog, text="ring", kind="dataset", owner="core@example.com").select(
        "name", "namespace", "owner", "description"
    )


@query(
    "P8",
    """SELECT name, namespace FROM catalog WHERE contains(lower(name), 'red w') OR contains(lower(description), 'red w')""",
)
def catalog_search_any_case(t):
    return C.search(t.catalog, text="Red W", ignore_case=True).select("name", "namespace")


@query(
    "P9",
    """SELECT namespace, name, tags_csv FROM catalog WHERE list_contains(tags, 'tier-1') AND list_contains(tags, 'gdpr')
       ORDER BY namespace, name LIMIT 25""",
)
def catalog_search_tags(t):
    return C.search(t.catalog, tags=["tier-1", "gdpr"], limit=25).select("namespace", "name", "tags_csv")


@query(
    "P10",
    """SELECT name, namespace, version FROM catalog
       WHERE type = 'job' AND namespace = 'team-2' AND list_contains(tags, 'tier-0') AND classification = 'internal'""",
)
def catalog_discovery(t):
    return C.search(t.catalog, kind="job", namespace="team-2", tags=["tier-0"], classification="internal").select(
        "name", "namespace", "version"
    )


@query(
    "J7",
    """WITH refs AS (SELECT dataset, 'dataset' AS kind, regexp_extract(from_ref, '^(.*)\\.[^.]*$', 1) AS target FROM fields WHERE from_ref IS NOT NULL
                     UNION ALL SELECT name, 'store', concat('store-', retention_days) FROM catalog WHERE retention_days IS NOT NULL),
            known AS (SELECT 'dataset' AS kind, name AS id FROM catalog WHERE type = 'dataset'
                      UNION ALL SELECT DISTINCT 'store', concat('store-', s_nationkey * 30) FROM supplier)
       SELECT kind, target, dataset FROM refs r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = r.kind AND k.id = r.target)""",
)
def dangling_references(t):
    columns = t.fields.filter("from_ref IS NOT NULL").select(
        "dataset", F.lit("dataset").alias("kind"), F.regexp_extract("from_ref", r"^(.*)\.[^.]*$", 1).alias("target")
    )
    stores = t.catalog.filter("retention_days IS NOT NULL").select(
        F.col("name").alias("dataset"), F.lit("store").alias("kind"),
        F.concat(F.lit("store-"), F.col("retention_days").cast("string")).alias("target"),
    )
    known = t.catalog.filter("type = 'dataset'").select(F.lit("dataset").alias("kind"), F.col("name").alias("id")).unionByName(
        t.supplier.select(F.lit("store").alias("kind"), F.concat(F.lit("store-"), (F.col("s_nationkey") * 30).cast("string")).alias("id"))
    )
    return C.dangling(columns.unionByName(stores), known).select("kind", "target", "dataset")


LOCK = """lock AS (SELECT DISTINCT concat(lower(p_type), '-', CAST(p_size AS STRING)) AS module FROM part WHERE p_retailprice < 1000)"""


def lock(t):
    named = F.concat(F.lower("p_type"), F.lit("-"), F.col("p_size").cast("string"))
    return t.part.filter("p_retailprice < 1000").select(named.alias("module")).distinct()


@query(
    "J8",
    f"""WITH {LOCK} SELECT dataset, schema_ref, string_split(schema_ref, '@')[1] AS module FROM schema_refs
        WHERE schema_ref IS NOT NULL AND string_split(schema_ref, '@')[1] NOT IN (SELECT module FROM lock)""",
)
def unlocked_references(t):
    return C.unlocked(t.schema_refs, lock(t)).select("dataset", "schema_ref", "module")


@query(
    "U4",
    f"""WITH {LOCK} SELECT string_split(schema_ref, '@')[1] AS module FROM schema_refs WHERE schema_ref IS NOT NULL
        EXCEPT SELECT module FROM lock""",
)
def unlocked_modules(t):
    return C.unlocked_modules(t.schema_refs, lock(t))


@query(
    "U3",
    """SELECT string_split(schema_ref, '@')[1] AS module, arg_min(schema_ref, "position") AS schema_ref, min("position") AS "position"
       FROM schema_refs WHERE schema_ref IS NOT NULL GROUP BY 1""",
)
def first_references(t):
    return C.first_per_module(t.schema_refs)


DIFF = """old AS (SELECT dataset, name, min(type) AS type FROM fields WHERE name <> 'amount' GROUP BY dataset, name),
  new AS (SELECT dataset, name, min(CASE WHEN name = 'key' THEN 'integer' ELSE type END) AS type FROM fields WHERE name <> '' GROUP BY dataset, name)"""


@query(
    "J9",
    f"""WITH {DIFF} SELECT dataset, name, o.type AS old_type, n.type AS new_type,
               CASE WHEN n.type IS NULL THEN 'field_removed' WHEN o.type IS NULL THEN 'field_added' ELSE 'type_changed' END AS change,
               o.type IS NOT NULL AS breaking
        FROM old o FULL JOIN new n USING (dataset, name) WHERE o.type IS DISTINCT FROM n.type""",
)
def schema_changes(t):
    fields = t.fields
    old = fields.filter("name <> 'amount'").groupBy("dataset", "name").agg(F.min("type").alias("type"))
    kind = F.when(F.col("name") == "key", "integer").otherwise(F.col("type"))
    new = fields.filter("name <> ''").groupBy("dataset", "name").agg(F.min(kind).alias("type"))
    return schema_diff(old, new)


@query(
    "L17",
    """SELECT dataset, name, count(*) AS occurrences, CASE WHEN name = '' THEN 'empty' ELSE 'duplicate' END AS problem
       FROM fields GROUP BY dataset, name HAVING count(*) > 1 OR name = ''""",
)
def field_name_problems(t):
    return duplicate_fields(t.fields)


@query(
    "U1",
    """SELECT concat_ws('/', namespace, name) AS id, type, namespace, name, owner FROM catalog""",
)
def catalog_listing(t):
    return C.listing(t.catalog.filter("type = 'dataset'"), t.catalog.filter("type = 'job'"))


@query("L11", "SELECT name, namespace, version FROM catalog WHERE namespace = 'team-1' AND type = 'dataset'")
def listed_records(t):
    return C.list_records(t.catalog, namespace="team-1", kind="dataset").select("name", "namespace", "version")


@query(
    "L11",
    """WITH changes AS (SELECT concat('ds-', l_partkey) AS name, concat('sup-', l_suppkey) AS owner, l_shipdate AS updated_at, l_orderkey, l_linenumber FROM lineitem),
            latest AS (SELECT name, owner, updated_at FROM changes
                       QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, l_orderkey, l_linenumber, owner) = 1)
       SELECT name, owner, updated_at FROM latest
       UNION ALL SELECT name, owner, updated_at FROM catalog WHERE name NOT IN (SELECT name FROM latest)""",
)
def catalog_upsert(t):
    changes = t.lineitem.select(
        F.concat(F.lit("ds-"), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.lit("sup-"), F.col("l_suppkey").cast("string")).alias("owner"),
        F.col("l_shipdate").alias("updated_at"), "l_orderkey", "l_linenumber",
    )
    order = [F.col("updated_at").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("owner")]
    return upsert(t.catalog.select("name", "owner", "updated_at"), changes, ["name"], order)


EVENT_COLUMNS = {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "float", "props": "string"}


def field_sql(name, kind):
    return f"""SELECT '{name}' AS field, '{kind}' AS field_type, {name == 'user_id'} AS pii,
                      count(*) FILTER (WHERE {name} IS NULL) / CAST(count(*) AS DOUBLE) AS null_rate FROM events"""


@query(
    "L12",
    f"""SELECT 'analytics/events' AS id, 'dataset' AS type, 'analytics' AS namespace, 'events' AS name, 'core@example.com' AS owner,
              'internal' AS classification, 'parquet' AS format, (SELECT count(*) FROM events) AS row_count, (SELECT max(ts) FROM events) AS freshness, f.*
       FROM ({" UNION ALL ".join(field_sql(n, kind) for n, kind in EVENT_COLUMNS.items())}) f""",
)
def catalog_record(t):
    """The record, with a row for each of its fields."""
    schema = [{"name": n, "type": kind, "pii": n == "user_id"} for n, kind in EVENT_COLUMNS.items()]
    contract = Contract.from_dict({"name": "events", "classification": "internal", "schema": schema})
    record = C.record_of(t.events, contract, "analytics", "core@example.com", "ts")
    return record.withColumn("f", F.explode("schema.fields")).select(
        "id", "type", "namespace", "name", "owner", "classification", F.col("schema.format").alias("format"),
        F.col("quality.rowCount").alias("row_count"), F.col("quality.freshness").alias("freshness"),
        F.col("f.name").alias("field"), F.col("f.type").alias("field_type"), F.col("f.pii").alias("pii"),
        F.col("quality.nullRate")[F.col("f.name")].alias("null_rate"),
    )
