"""Database adoption report: which releases use a managed database, which one only shows signs of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.functions.collections import joined
from weirgate.operators.windows import newest

RELEASE_KEYS = ("cluster", "namespace", "release_name")
# Names and text that point to a database connection.
DATABASE_SIGNALS = ("DATABASE_URL", "PGHOST", "DB_HOST", "jdbc:")
# Order-status letters of the raw tables and their normal form.
STATUS_NAMES = {"o": "pending", "f": "failed", "p": "deployed"}


def signal(text: Column) -> Column:
    return text.rlike("|".join(DATABASE_SIGNALS))


def normal_status(status: Column) -> Column:
    """Lower-case, trimmed, single-letter forms spelled out."""
    plain = F.lower(F.trim(status))
    named = F.when(plain.isNull() | (plain == ""), "unknown")
    for letter, name in STATUS_NAMES.items():
        named = named.when(plain == letter, name)
    return named.otherwise(plain)


def chart_values(releases: DataFrame, json_column: str = "values_json") -> DataFrame:
    """Chart name, version and application version from the JSON text of each release."""
    fields = F.from_json(F.col(json_column), "chart STRUCT<name: STRING, version: STRING, appVersion: STRING>")
    chart = fields["chart"]
    return releases.select(
        *[c for c in releases.columns if c != json_column],
        chart["name"].alias("chart_name"),
        chart["version"].alias("chart_version"),
        chart["appVersion"].alias("app_version"),
    )


def stage_releases(releases: DataFrame) -> DataFrame:
    """Newest record of each release with its status normalised."""
    latest = newest(releases, RELEASE_KEYS, [F.col("collected_at").desc(), F.col("row_id").desc()])
    return latest.withColumn("status", normal_status(F.col("status")))


def stage_claims(claims: DataFrame) -> DataFrame:
    """Newest record of each claim: status normalised, instance label taken from the claim name."""
    keys = ("cluster", "namespace", "claim_name")
    latest = newest(claims, keys, [F.col("collected_at").desc(), F.col("row_id").desc()])
    return latest.withColumn("status", normal_status(F.col("status"))).withColumn(
        "instance_label", F.regexp_extract("claim_name", r"^([a-z]+)", 1)
    )


def indicators_from_json(resources: DataFrame, json_column: str, kind: Column) -> DataFrame:
    """One row per database signal among the keys or values of each resource's JSON object.

    Text without a signal and without an escape that could hide one is not parsed at all.
    """
    resources = resources.filter(signal(F.col(json_column)) | F.col(json_column).contains("\\"))
    entries = F.map_entries(F.from_json(F.col(json_column), "map<string,string>"))
    hits = F.filter(entries, lambda e: signal(e["key"]) | F.coalesce(signal(e["value"]), F.lit(False)))
    return resources.withColumn("__hit", F.explode(hits)).select(
        "cluster",
        "namespace",
        F.col("resource_name").alias("release_name"),
        kind.alias("indicator_type"),
        F.col("__hit")["key"].alias("indicator_key"),
    )


def has_signal(json_text: Column) -> Column:
    """Whether the JSON object of a resource has a database signal among its keys or values."""
    entries = F.map_entries(F.from_json(json_text, "map<string,string>"))
    found = F.exists(entries, lambda e: signal(e["key"]) | F.coalesce(signal(e["value"]), F.lit(False)))
    return F.coalesce(found, F.lit(False))


def indicator_rows(resource_keys: DataFrame) -> DataFrame:
    """Database signals per release from rows of (resource, type, key), repeated ones as they come."""
    found = resource_keys.filter(signal(F.col("indicator_key")))
    return found.select("cluster", "namespace", F.col("resource_name").alias("release_name"), "indicator_type", "indicator_key")


def indicator_types(indicators: DataFrame) -> DataFrame:
    """Indicator types of each release as one sorted text. The set holds a few kinds of resource."""
    return indicators.groupBy(*RELEASE_KEYS).agg(
        joined(F.collect_set("indicator_type")).alias("indicator_types")
    )


def _claims_by_release(claims: DataFrame) -> DataFrame:
    return claims.select(
        "cluster", "namespace", F.col("claim_name").alias("release_name"), F.col("db_type")
    ).groupBy(*RELEASE_KEYS).agg(F.min("db_type").alias("db_type"))


def assessment(has_claim: Column, has_indicators: Column) -> Column:
    return F.when(has_claim, "managed").when(has_indicators, "unmanaged").otherwise("no-db")


def adoption_report(releases: DataFrame, claims: DataFrame, indicators: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """One row per release, stamped with ``updated_at`` (now by default).

    Claims and indicators, in which signals may repeat, are reduced to a row per release before the joins.
    """
    claimed = _claims_by_release(claims).withColumn("has_dbclaim", F.lit(True))
    shown = indicator_types(indicators).withColumn("has_db_indicators", F.lit(True))
    return (
        releases.join(claimed, list(RELEASE_KEYS), "left")
        .join(shown, list(RELEASE_KEYS), "left")
        .select(
            *RELEASE_KEYS,
            "chart_name",
            F.coalesce("has_dbclaim", F.lit(False)).alias("has_dbclaim"),
            F.coalesce("has_db_indicators", F.lit(False)).alias("has_db_indicators"),
            F.coalesce("indicator_types", F.lit("")).alias("indicator_types"),
            "db_type",
        )
        .withColumn("assessment", assessment(F.col("has_dbclaim"), F.col("has_db_indicators")))
        .withColumn("updated_at", F.current_timestamp() if updated_at is None else updated_at)
    )


def releases_with_claim(releases: DataFrame, claims: DataFrame) -> DataFrame:
    return releases.join(_claims_by_release(claims), list(RELEASE_KEYS), "left_semi")


def releases_with_signals_only(releases: DataFrame, claims: DataFrame, indicators: DataFrame) -> DataFrame:
    unclaimed = releases.join(_claims_by_release(claims), list(RELEASE_KEYS), "left_anti")
    return unclaimed.join(indicators.select(*RELEASE_KEYS), list(RELEASE_KEYS), "left_semi")


def posture(report: DataFrame, every_combination: bool = False) -> DataFrame:
    """Releases per assessment for each cluster and namespace, each cluster, and overall.

    ``level`` is 0 for cluster and namespace, 1 for cluster, 3 for overall (2 for namespace alone, which
    only ``every_combination`` adds).
    """
    grouped = report.cube("cluster", "namespace") if every_combination else report.rollup("cluster", "namespace")
    return grouped.agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("releases"),
        *[
            F.count_if(F.col("assessment") == a).alias(a.replace("-", "_"))
            for a in ("managed", "unmanaged", "no-db")
        ],
    )
