"""Sinks: every query writes to the scratch folder and returns what a reader finds there."""

import uuid

from pyspark.sql import functions as F

from weirgate.contracts import Contract
from weirgate.contracts.types import contract_type
from weirgate.operators import runs as R
from weirgate.operators.events import date_range, name_summary
from weirgate.operators.fingerprint import fingerprints
from weirgate.plans.digests import CUSTOMER, ORDERS, tables_sql
from weirgate.plans.queries.events import named_events
from weirgate.plans.registry import query
from weirgate.session import scratch_path
from weirgate.sources import keyed, writers
from weirgate.sources.readers import read_files
from weirgate.sources.versions import VersionedTable, refresh_versions


@query("K1", "SELECT event_id, event_type, value FROM events")
def appended_files(t):
    prefix = scratch_path(t.spark, "append")
    events = t.events.select("event_id", "event_type", "value")
    noon = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    for part in (t.events.filter(F.col("ts") < noon), t.events.filter(F.col("ts") >= noon)):
        path = writers.append_files(part.select(*events.columns), prefix, "events")
    return t.spark.read.schema(events.schema).parquet(path)


@query("K2", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def single_file(t):
    summary = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    path = writers.write_single_file(summary, scratch_path(t.spark, "single"), "summary")
    return t.spark.read.schema(summary.schema).json(path)


@query(
    "K3",
    """SELECT 'parquet' AS format, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'json', o_orderkey, o_totalprice FROM orders
       UNION ALL SELECT 'csv', o_orderkey, o_totalprice FROM orders""",
)
def per_dataset_format(t):
    fields = [{"name": "o_orderkey", "type": "bigint"}, {"name": "o_totalprice", "type": "number"}]
    prefix = scratch_path(t.spark, "formats")
    result = None
    for name in ("parquet", "json", "csv"):
        contract = Contract.from_dict({"name": f"orders-{name}", "format": name, "schema": fields})
        path = writers.save_contract(t.orders, contract, prefix)
        back = read_files(t.spark, path, contract).withColumn("format", F.lit(name))
        result = back if result is None else result.unionByName(back)
    return result


@query(
    "K4 K13",
    f"""SELECT d.destination, p.table_name, p.row_count AS rows_written, 0 AS errors, p.fingerprint
       FROM ({tables_sql({"customer": CUSTOMER, "orders": ORDERS})}) p CROSS JOIN (VALUES ('lake'), ('mirror')) AS d(destination)""",
)
def fan_out(t):
    """The summary of the sync, with the fingerprint of the rows that a reader finds at each destination."""
    prefix = scratch_path(t.spark, "fan")
    tables = {"customer": t.customer, "orders": t.orders}

    def to(folder):
        return lambda name, df: writers.append_files(df, f"{prefix}/{folder}", name)

    summary = writers.fan_out(tables, {"lake": to("lake"), "mirror": to("mirror")})
    found = None
    for place in ("lake", "mirror"):
        for name, df in tables.items():
            rows = fingerprints(t.spark.read.schema(df.schema).parquet(f"{prefix}/{place}/{name}"))
            rows = rows.select(F.lit(place).alias("destination"), F.lit(name).alias("table_name"), "fingerprint")
            found = rows if found is None else found.unionByName(rows)
    return summary.join(found, ["destination", "table_name"]).select("destination", "table_name", "rows_written", "errors", "fingerprint")


def versioned(t, label, partition_by=None):
    """A new versioned table of its own name, below the scratch folder."""
    return VersionedTable(t.spark, f"{label}_{uuid.uuid4().hex}", scratch_path(t.spark, label), partition_by)


@query("K6", "SELECT * EXCLUDE (o_orderstatus) FROM orders WHERE o_orderstatus <> 'F'")
def refreshed_table(t):
    table = versioned(t, "refresh")
    table.replace(t.orders, "load")
    kept = table.read().filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    for _ in range(2):  # the repeated run changes nothing
        table.replace(kept, "refresh")
    return table.read()


@query("K7", "SELECT c_custkey, c_name FROM customer")
def recreated_table(t):
    table = f"recreated_{uuid.uuid4().hex}"
    path = scratch_path(t.spark, "recreate")
    writers.recreate_table(t.customer.select("c_custkey", "c_acctbal"), table, path)
    writers.recreate_table(t.customer.select("c_custkey", "c_name"), table, path)
    return t.spark.table(table)


@query("K8", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer")
def created_if_absent(t):
    contract = Contract.from_dict(
        {"name": "customer", "schema": [{"name": "c_custkey", "type": "bigint"}, {"name": "c_name"}]}
    )
    prefix = scratch_path(t.spark, "create")
    created = writers.create_if_absent(t.spark, f"{prefix}/customer", contract)
    path = writers.save_contract(t.customer, contract, prefix)
    assert created and not writers.create_if_absent(t.spark, path, contract)
    return t.spark.read.schema(contract.schema).parquet(path)


@query(
    "K9",
    """WITH latest AS (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal FROM orders
                       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
       SELECT c_custkey, c_acctbal FROM latest UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM latest)""",
)
def upserted_table(t):
    table = versioned(t, "upsert")
    table.replace(t.customer.select("c_custkey", "c_acctbal"), "load")
    changes = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey"
    )
    table.upsert(changes, ["c_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], "orders")
    return table.read()


@query(
    "K9",
    """WITH moved AS (SELECT * REPLACE ('BUILDING' AS c_mktsegment) FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0)
       SELECT * FROM moved UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM moved)""",
)
def upserted_partitions(t):
    table = versioned(t, "partitions", "c_mktsegment")
    table.replace(t.customer, "load")
    moved = t.customer.filter("c_mktsegment = 'MACHINERY' AND c_acctbal > 0").withColumn("c_mktsegment", F.lit("BUILDING"))
    table.upsert(moved, ["c_custkey"], [F.col("c_name")], "move")
    return table.read()


@query("K10", "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS date FROM events")
def partitioned_files(t):
    path = scratch_path(t.spark, "dates")
    dated = t.events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    writers.write_partitioned(dated, path, "date", "snappy")
    return t.spark.read.schema(dated.schema).parquet(path)


@query(
    "P11 K10",
    """SELECT event_id, CASE WHEN strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-07' THEN 'rewritten' ELSE event_type END AS event_type,
              strftime(ts, '%Y-%m-%d') AS date FROM events""",
)
def backfilled_partitions(t):
    path = scratch_path(t.spark, "backfill")
    date = F.date_format("ts", "yyyy-MM-dd").alias("date")
    dated = t.events.select("event_id", "event_type", date)
    writers.write_partitioned(dated, path, "date")
    again = date_range(t.events, "ts", "2024-01-05", "2024-01-07").select(
        "event_id", F.lit("rewritten").alias("event_type"), date
    )
    writers.write_partitioned(again, path, "date", mode="overwrite")
    return t.spark.read.schema(dated.schema).parquet(path)


@query(
    "K11",
    "SELECT concat('user-', CAST(user_id AS STRING)) AS name, min(ts) AS first_seen, count(*) AS row_count FROM events GROUP BY user_id",
)
def materialised_model(t):
    table = f"summary_{uuid.uuid4().hex}"
    return writers.save_model(name_summary(named_events(t)), table, path=scratch_path(t.spark, "model"))


@query(
    "K12",
    """SELECT run_id, event_type, event_time, job_name, place FROM lineage_events CROSS JOIN (VALUES ('log'), ('copy')) AS p(place)""",
)
def event_log(t):
    prefix, events = scratch_path(t.spark, "events"), t.lineage_events
    starts = events.filter("event_type = 'START'"), events.filter("event_type <> 'START'")
    for run, rows in (("a", starts[0]), ("b", starts[1]), ("b", starts[1])):  # the second run is repeated
        errors = writers.append_events(
            rows,
            [
                lambda df, run=run: writers.append_files(df, prefix, "log", run=run),
                lambda df, run=run: writers.append_files(df, prefix, "copy", "json", run=run),
            ],
        )
        assert not errors, errors
    reader = t.spark.read.schema(events.schema)
    log, copy = reader.parquet(f"{prefix}/log").drop("run"), reader.json(f"{prefix}/copy").drop("run")
    return log.withColumn("place", F.lit("log")).unionByName(copy.withColumn("place", F.lit("copy")))


@query(
    "K14",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY'
       UNION ALL SELECT c_custkey + 1000000000, c_acctbal FROM customer WHERE c_mktsegment = 'HOUSEHOLD'""",
)
def keyed_changes(t):
    current = t.customer.select("c_custkey", "c_acctbal")
    kind = (
        F.when(F.col("c_mktsegment") == "BUILDING", "update")
        .when(F.col("c_mktsegment") == "MACHINERY", "delete")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "create")
    )
    marked = t.customer.withColumn("op", kind).filter(F.col("op").isNotNull())
    changes = marked.select(
        F.when(F.col("op") == "create", F.col("c_custkey") + 1000000000).otherwise(F.col("c_custkey")).alias("c_custkey"),
        F.when(F.col("op") == "update", F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "op",
    )
    return keyed.apply_changes(current, changes, ["c_custkey"])


@query(
    "K14",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT c_custkey FROM customer) THEN 'already exists' ELSE 'not found' END AS reason
       FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'create' WHEN 'O' THEN 'update' ELSE 'delete' END AS op FROM orders)
       WHERE (op = 'create') = (o_orderkey IN (SELECT c_custkey FROM customer))""",
)
def rejected_changes(t):
    op = F.when(F.col("o_orderstatus") == "P", "create").when(F.col("o_orderstatus") == "O", "update").otherwise("delete")
    changes = t.orders.select(F.col("o_orderkey").alias("id"), op.alias("op"))
    known = t.customer.select(F.col("c_custkey").alias("id"))
    return keyed.rejected_changes(known, changes, ["id"]).select(F.col("id").alias("o_orderkey"), "reason")


@query(
    "K15",
    """SELECT id, package, environment, start_time, status, end_time, duration_ms, CASE WHEN status <> 'running' THEN records_processed END AS records_processed,
              CASE WHEN status = 'failure' THEN 'exit 1' END AS error_message FROM runs""",
)
def completed_runs(t):
    runs = t.runs
    opened = runs.select("id", "package", "environment", "start_time", F.lit("running").alias("status"))
    done = runs.filter("status <> 'running'").select(
        "id", "status", "end_time", "records_processed",
        F.when(F.col("status") == "failure", "exit 1").alias("error_message"),
    )
    return R.complete_runs(opened, done)


@query("D1", "SELECT * FROM customer WHERE c_acctbal > 0")
def refreshed_on_change(t):
    names = [(f.name, contract_type(f.dataType)) for f in t.customer.schema]
    contract = Contract.from_dict({"name": "customer", "schema": [{"name": n, "type": kind} for n, kind in names]})
    table = versioned(t, "seeded")
    first = refresh_versions(table, contract, t.customer, "monday")
    again = refresh_versions(table, contract, t.customer.repartition(3), "tuesday")
    changed = refresh_versions(table, contract, t.customer.filter("c_acctbal > 0"), "wednesday")
    assert (first.loaded, again.loaded, changed.loaded) == (True, False, True)
    return table.read()
