"""Lineage events, facets, and column lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.functions.times import micros, millis_between, seconds_between
from weirgate.operators.graph import reach
from weirgate.operators.windows import previous_instant
from weirgate.session import written

# Event types that end a run, with the run status they stand for.
END_STATUS = {"COMPLETE": "success", "FAIL": "failure", "ABORT": "cancelled"}
HEARTBEAT_SECONDS = 30


def graph_edges(events: DataFrame) -> DataFrame:
    """Distinct edges of nested events: each input to its job, each job to its outputs."""
    job = F.col("job")["name"]
    reads = F.transform("inputs", lambda d: F.struct(d["name"].alias("src"), job.alias("dst")))
    writes = F.transform("outputs", lambda d: F.struct(job.alias("src"), d["name"].alias("dst")))
    return events.select(F.inline(F.concat(reads, writes))).distinct()


def run_facets(events: DataFrame) -> DataFrame:
    """Error message, parent run, delay against the nominal start, and row counts, out of facet JSON."""
    facets = F.col("run")["facets"]

    def path(facet: str, where: str) -> Column:
        return F.get_json_object(F.try_element_at(facets, F.lit(facet)), where)

    nominal = F.try_to_timestamp(path("nominalTime", "$.nominalStartTime"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return events.select(
        F.col("run")["runId"].alias("run_id"),
        "eventType",
        path("errorMessage", "$.message").alias("error_message"),
        path("parent", "$.run.runId").alias("parent_run_id"),
        seconds_between(nominal, F.col("eventTime")).alias("delay_seconds"),
        F.aggregate(
            F.transform(
                F.coalesce("outputs", F.array()),
                lambda d: F.coalesce(
                    F.get_json_object(F.try_element_at(d["facets"], F.lit("dataQualityMetrics")), "$.rowCount").try_cast("bigint"),
                    F.lit(0).cast("bigint"),
                ),
            ),
            F.lit(0).cast("bigint"),
            lambda total, n: total + n,
        ).alias("rows_written"),
    )


def schema_fields(events: DataFrame) -> DataFrame:
    """Distinct columns that the schema facets of output datasets declare."""
    fields = "STRUCT<fields: ARRAY<STRUCT<name: STRING, type: STRING>>>"
    datasets = events.select(F.explode("outputs").alias("d"))
    parsed = F.from_json(F.try_element_at(F.col("d")["facets"], F.lit("schema")), fields)["fields"]
    return (
        datasets.select(F.col("d")["name"].alias("dataset"), F.explode(parsed).alias("f"))
        .select("dataset", F.col("f")["name"].alias("name"), F.col("f")["type"].alias("type"))
        .distinct()
    )


def run_lifecycle(events: DataFrame, as_of: Column | None = None, timeout_seconds: int | None = None) -> DataFrame:
    """One row per run from its START, COMPLETE, FAIL and ABORT events.

    Earliest start, latest end and its status. A run without an end is running, or stale once
    ``timeout_seconds`` have passed. Only timestamps are aggregated, so this is a hash aggregate that
    combines before the shuffle, however chatty a run is.
    """
    moments = [
        F.min(F.when(F.col("event_type") == "START", F.col("event_time"))).alias("start_time"),
        *[F.max(F.when(F.col("event_type") == e, F.col("event_time"))).alias(e) for e in END_STATUS],
    ]
    end = F.greatest(*END_STATUS)
    status = F.lit("running")
    if timeout_seconds is not None:
        overdue = seconds_between(F.col("start_time"), as_of) > timeout_seconds
        status = F.when(overdue, "stale").otherwise("running")
    for event_type, name in END_STATUS.items():
        status = F.when(F.col(event_type) == F.col("end_time"), name).otherwise(status)
    return (
        events.groupBy("run_id", "job_name").agg(*moments)
        .withColumn("end_time", end)
        .select(
            "run_id", "job_name", "start_time", "end_time", status.alias("status"),
            millis_between(F.col("start_time"), F.col("end_time")).alias("duration_ms"),
        )
    )


def heartbeat_gaps(heartbeats: DataFrame, interval_seconds: int = HEARTBEAT_SECONDS, allowed: float = 2.0) -> DataFrame:
    """Gap before each heartbeat of a run; more than ``allowed`` intervals means some were missed."""
    steps = previous_instant(heartbeats, ("run_id",), "event_time", "previous_time")
    gap = (micros(F.col("event_time")) - micros(F.col("previous_time"))) / F.lit(1_000_000.0)
    return steps.withColumn("gap_seconds", gap).withColumn(
        "missed", F.coalesce(F.col("gap_seconds") > interval_seconds * allowed, F.lit(False))
    )


def column_edges(fields: DataFrame) -> DataFrame:
    """Edges from the declared source of each column (``dataset.column``, split at the last dot) to it."""
    ref = F.col("from_ref")
    return fields.filter(ref.isNotNull()).select(
        F.regexp_extract(ref, r"^(.*)\.([^.]*)$", 1).alias("src_dataset"),
        F.regexp_extract(ref, r"^(.*)\.([^.]*)$", 2).alias("src_column"),
        F.col("dataset").alias("dst_dataset"),
        F.col("name").alias("dst_column"),
    )


def column_id(dataset: Column, name: Column) -> Column:
    return F.concat_ws(".", dataset, name)


def _id_edges(fields: DataFrame) -> DataFrame:
    return column_edges(fields).select(
        column_id(F.col("src_dataset"), F.col("src_column")).alias("src"),
        column_id(F.col("dst_dataset"), F.col("dst_column")).alias("dst"),
    )


def column_origins(fields: DataFrame, column: str) -> DataFrame:
    """Origin columns of one column: those upstream of it that have no declared source themselves."""
    edges = _id_edges(fields)
    seeds = fields.sparkSession.createDataFrame([(column,)], "node string")
    above = reach(edges, seeds, "up")
    derived = edges.select(F.col("dst").alias("node")).distinct()
    return above.join(derived, "node", "left_anti").select(F.col("node").alias("origin"), "depth")


def pii_flow(fields: DataFrame) -> DataFrame:
    """Columns derived from a personal-data column, with whether they are marked as such themselves.

    All marked columns start the search together, so each column is found once.
    """
    node = column_id(F.col("dataset"), F.col("name")).alias("node")
    flagged = written(fields.groupBy(node, "dataset").agg(F.bool_or("pii").alias("pii")), "flagged")
    marked = flagged.filter("pii").select(F.col("node").alias("src"))
    edges = _id_edges(fields)
    below = reach(edges, edges.join(marked, "src", "left_semi").select(F.col("dst").alias("node")), "down")
    return below.select("node").join(flagged, "node").select(
        F.col("node").alias("column_id"), "dataset", F.col("pii").alias("marked")
    )


def pii_flow_counts(flow: DataFrame) -> DataFrame:
    return flow.agg(
        F.count_distinct("dataset").alias("affected_datasets"),
        F.count(F.lit(1)).alias("affected_columns"),
        F.count_if(~F.col("marked")).alias("unmarked_columns"),
    )
