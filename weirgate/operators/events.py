"""Event reshaping, enrichment, rollups and summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.collections import json_or_empty


def reshape_events(raw: DataFrame, names: Mapping[str, str], processed_at: Column | None = None) -> DataFrame:
    """Raw events under the processed names, stamped with the processing time.

    ``names`` maps output to input columns. A column the input lacks becomes NULL; nested properties
    become JSON text, ``{}`` when absent.
    """
    types = {f.name: f.dataType for f in raw.schema.fields}
    columns = []
    for out, source in names.items():
        if source not in types:
            columns.append(F.lit(None).cast("string").alias(out))
        elif isinstance(types[source], (T.StructType, T.MapType, T.ArrayType)):
            columns.append(json_or_empty(F.col(source)).alias(out))
        else:
            columns.append(F.col(source).alias(out))
    stamp = F.current_timestamp() if processed_at is None else processed_at
    return raw.select(*columns, stamp.alias("processed_at"))


def enrich_events(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with the name and e-mail of their user; events of unknown users are kept.

    Spark broadcasts the users when their size allows it; otherwise AQE splits a user with many events.
    """
    known = users.select("user_id", "user_name", "user_email")
    return events.join(known, "user_id", "left")


def name_summary(df: DataFrame) -> DataFrame:
    """First time and number of rows per name, earliest first."""
    return (
        df.groupBy("name")
        .agg(F.min("created_at").alias("first_seen"), F.count(F.lit(1)).alias("row_count"))
        .orderBy("first_seen", "name")
    )


def _by_day(events: DataFrame, key: str, *measures: Column) -> DataFrame:
    """Grouped by the date itself; its text is made once per result row."""
    grouped = events.groupBy(F.to_date("ts").alias("__day"), key).agg(*measures)
    day = F.date_format("__day", "yyyy-MM-dd").alias("date")
    return grouped.select(day, *[c for c in grouped.columns if c != "__day"])


def daily_rollup(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Events and distinct users per day and event type.

    The exact distinct count shuffles by (day, type, user), so no single day or type lands in one task.
    """
    users = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return _by_day(events, "event_type", F.count(F.lit(1)).alias("total_events"), users.alias("unique_users"))


def daily_user_summary(events: DataFrame) -> DataFrame:
    """Events per day and user."""
    return _by_day(
        events, "user_id", F.count(F.lit(1)).alias("total_events"), F.count_distinct("event_type").alias("event_types")
    )


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("total_count"))


def date_range(df: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Rows of the days ``first`` to ``last``, both included; the first day must come before the last.

    The bounds are compared with the column itself, so they reach the scan.
    """
    from datetime import date, timedelta

    start, end = date.fromisoformat(first), date.fromisoformat(last)
    if start >= end:
        raise ValueError(f"backfill range must go forward: {first} to {last}")
    kind = df.schema[at].dataType
    after = (end + timedelta(days=1)).isoformat()
    return df.filter((F.col(at) >= F.lit(first).cast(kind)) & (F.col(at) < F.lit(after).cast(kind)))


def preview(df: DataFrame, *order: str, rows: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(rows)
