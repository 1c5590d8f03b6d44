"""Scans: files with a contract, inline rows, groups, cells, tags, custom tables, change logs."""

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from weirgate.contracts import Contract
from weirgate.contracts.types import Field
from weirgate.operators.catalog import resolve
from weirgate.operators.fingerprint import fingerprints
from weirgate.plans.digests import CUSTOMER, LINEITEM, ORDERS, tables_sql
from weirgate.plans.registry import query
from weirgate.session import scratch_path
from weirgate.sources.custom import read_resolved
from weirgate.sources.keyed import apply_change_log
from weirgate.sources.readers import inline_rows, read_cells, read_files, read_json_array, read_tables

EVENTS = Contract.from_dict(
    {
        "name": "events",
        "schema": [
            {"name": "event_id", "type": "bigint"},
            {"name": "user_id", "type": "bigint"},
            {"name": "event_type", "type": "string"},
            {"name": "value", "type": "float"},
        ],
    }
)


EVENT_FILES = Contract(EVENTS.name, (*EVENTS.fields, Field("props")))


@query("S1", "SELECT event_id, user_id, event_type, value, props FROM events")
def parquet_scan(t):
    return read_files(t.spark, t.path("events"), EVENT_FILES)


@query("S2", "SELECT event_id, user_id, event_type, value FROM events")
def json_scan(t):
    path = scratch_path(t.spark, "json")
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return read_files(t.spark, path, Contract("events", EVENTS.fields, format="json"))


CUSTOMERS = Contract.from_dict(
    {
        "name": "customers",
        "format": "csv",
        "schema": [
            {"name": "c_custkey", "type": "bigint"},
            {"name": "c_name", "type": "string"},
            {"name": "c_acctbal", "type": "number"},
        ],
    }
)


@query("S3", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_scan(t):
    path = scratch_path(t.spark, "csv")
    t.customer.select("c_name", "c_custkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return read_files(t.spark, path, CUSTOMERS)


@query("S4", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_array_scan(t):
    """Seed files of one JSON array each, every array holding one Arrow batch of the table."""
    fields = [{"name": "s_suppkey", "type": "bigint"}, {"name": "s_name"}, {"name": "s_acctbal", "type": "float"}]

    def arrays(batches):
        for batch in batches:
            yield pd.DataFrame({"value": [batch.to_json(orient="records", double_precision=15)]})

    path = scratch_path(t.spark, "arrays")
    packed = t.supplier.select("s_suppkey", "s_name", "s_acctbal").mapInPandas(arrays, "value string")
    packed.write.option("maxRecordsPerFile", 1).text(path)
    return read_json_array(t.spark, path, Contract.from_dict({"name": "suppliers", "schema": fields}))


@query(
    "S8",
    """SELECT severity, count(*) AS events FROM events
       LEFT JOIN (VALUES ('error', 3), ('signup', 1), ('view', NULL)) AS s(event_type, severity) USING (event_type)
       GROUP BY severity""",
)
def inline_scan(t):
    contract = Contract.from_dict(
        {"name": "severities", "schema": [{"name": "event_type"}, {"name": "severity", "type": "integer"}]}
    )
    rows = [{"event_type": "error", "severity": 3}, {"event_type": "signup", "severity": 1}, {"event_type": "view"}]
    levels = inline_rows(t.spark, rows, contract)
    return t.events.join(levels, "event_type", "left").groupBy("severity").agg(F.count(F.lit(1)).alias("events"))


@query("S10", tables_sql({"customer": CUSTOMER, "orders": ORDERS, "lineitem": LINEITEM}))
def sync_scan(t):
    """Every table that is wanted is read once, whole; its rows are told by their fingerprint."""
    wanted = [Contract(n, table=n, store="warehouse") for n in ("customer", "orders", "customer", "lineitem")]
    tables = read_tables(wanted, lambda c: t.spark.read.parquet(t.path(c.locator)))
    prints = [fingerprints(df).select(F.lit(name).alias("table_name"), "row_count", "fingerprint") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), prints)


@query(
    "S11",
    """SELECT c_mktsegment, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""",
)
def group_scan(t):
    group = [Contract(n, store="warehouse") for n in ("customer", "orders")]
    frames = read_tables(group, lambda c: t.spark.read.parquet(t.path(c.name)))
    joined = frames["customer"].join(frames["orders"], F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "S12 U2",
    """SELECT cluster AS cell, namespace, count(*) AS releases,
              count(CASE WHEN cluster <> 'c2' THEN chart_version END) AS versions
       FROM helm_releases GROUP BY cluster, namespace""",
)
def cell_fan_in(t):
    releases = t.helm_releases

    def read(cell):
        own = releases.filter(F.col("cluster") == cell).drop("cluster")
        return own.drop("chart_version") if cell == "c2" else own

    union = read_cells(["c0", "c1", "c2"], read)
    return union.groupBy("cell", "namespace").agg(
        F.count(F.lit(1)).alias("releases"), F.count("chart_version").alias("versions")
    )


@query(
    "S13",
    """SELECT name, version, owner FROM (
         SELECT name, version, owner, row_number() OVER (PARTITION BY name ORDER BY
                list_transform(string_split(version, '.'), lambda x: CAST(x AS BIGINT)) DESC, record_id) AS rn
         FROM (SELECT description AS name, version, owner, record_id, tags FROM catalog)
         WHERE list_contains(tags, 'tier-1') AND list_contains(tags, 'gdpr')
           AND string_split(version, '.')[1] = '1' AND CAST(string_split(version, '.')[2] AS BIGINT) >= 2)
       WHERE rn = 1""",
)
def resolve_by_tags(t):
    records = t.catalog.withColumn("name", F.col("description"))
    return resolve(records, ["tier-1", "gdpr"], "^1.2.0").select("name", "version", "owner")


@query("S14 V4", "SELECT event_id, event_type, value > 10 AS above_ten FROM events")
def custom_table(t):
    contract = Contract.from_dict(
        {
            "name": "scored_events",
            "schema": [
                {"name": "event_id", "type": "int64"},
                {"name": "event_type", "type": "string"},
                {"name": "above_ten", "type": "boolean"},
            ],
        }
    )

    def resolver(file):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(file)
        table = pq.ParquetFile(path, filesystem=store)
        for batch in table.iter_batches(columns=["event_id", "event_type", "value"]):
            above = pc.greater(batch["value"], 10)
            yield pa.RecordBatch.from_arrays([batch["event_id"], batch["event_type"], above], ["event_id", "event_type", "above_ten"])

    return read_resolved(t.spark, contract, resolver, t.events.inputFiles())


@query(
    "S15",
    """WITH changes AS (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal, o_orderkey AS pos,
                               CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'O' THEN 'update' ELSE 'insert' END AS op
                        FROM orders),
            latest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pos DESC) = 1)
       SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM latest)
       UNION ALL SELECT c_custkey, c_acctbal FROM latest WHERE op <> 'delete'""",
)
def change_log_scan(t):
    operation = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "update")
    changes = t.orders.select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderkey").alias("position"),
        operation.otherwise("insert").alias("op"),
    )
    return apply_change_log(t.customer.select("c_custkey", "c_acctbal"), changes, ["c_custkey"])


