"""Governance reports: policies, cross-boundary flows, and retention."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.functions.collections import classification_rank, has_all_tags

# Fixed values of the default policy.
OWNER_PATTERN = r"^[a-z-]+@example\.com$"
MAX_PII_RETENTION_DAYS = 730
NEEDS_RETENTION = ("confidential", "restricted")
REQUIRED_TAGS = {"confidential": ("gdpr",)}
APPROACHING_DAYS = 30


def governance_report(records: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Per namespace: packages, those with personal data, one count per classification, and coverage of
    classification, retention and owner in percent. With flows, also the number that cross a boundary."""
    total = F.count(F.lit(1))

    def coverage(column: str) -> Column:
        return F.count(column).cast("double") / total * 100

    report = records.groupBy("namespace").agg(
        total.alias("packages"),
        F.count_if("pii").alias("with_pii"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in ("public", "internal", "confidential", "restricted")],
        coverage("classification").alias("classification_pct"),
        coverage("retention_days").alias("retention_pct"),
        coverage("owner").alias("owner_pct"),
    )
    if flows is None:
        return report
    crossing = flows.groupBy(F.col("src_namespace").alias("namespace")).agg(F.count(F.lit(1)).alias("cross_boundary_flows"))
    return report.join(crossing, "namespace", "left").fillna(0, ["cross_boundary_flows"])


def pii_ends(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Personal-data sources (nothing upstream) and sinks (nothing downstream) per namespace."""
    marked = records.filter("pii").select("name", "namespace")
    has_in = edges.select(F.col("dst").alias("name")).distinct().withColumn("has_in", F.lit(True))
    has_out = edges.select(F.col("src").alias("name")).distinct().withColumn("has_out", F.lit(True))
    return (
        marked.join(has_in, "name", "left").join(has_out, "name", "left").groupBy("namespace").agg(
            F.count_if(F.col("has_in").isNull()).alias("pii_sources"),
            F.count_if(F.col("has_out").isNull()).alias("pii_sinks"),
        )
    )


def cross_boundary(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges between namespaces, or from a higher to a lower classification."""
    rank = classification_rank(F.col("classification"))
    src = records.select(F.col("name").alias("src"), F.col("namespace").alias("src_namespace"), rank.alias("src_rank"))
    dst = records.select(F.col("name").alias("dst"), F.col("namespace").alias("dst_namespace"), rank.alias("dst_rank"))
    lowered = F.coalesce(F.col("dst_rank") < F.col("src_rank"), F.lit(False))
    moved = F.col("src_namespace") != F.col("dst_namespace")
    return (
        edges.select("src", "dst").join(src, "src").join(dst, "dst")
        .filter(moved | lowered)
        .select("src", "dst", "src_namespace", "dst_namespace", moved.alias("crosses_namespace"), lowered.alias("lowers_classification"))
    )


def policy_violations(
    records: DataFrame,
    owner_pattern: str = OWNER_PATTERN,
    max_pii_days: int = MAX_PII_RETENTION_DAYS,
    required_tags: Mapping[str, Iterable[str]] = REQUIRED_TAGS,
) -> DataFrame:
    """One row per record and broken rule. All rules are checked in one pass without a shuffle."""
    classification, days = F.col("classification"), F.col("retention_days")
    rules = {
        "classification_required_for_pii": F.col("pii") & classification.isNull(),
        "owner_required": F.col("owner").isNull(),
        "owner_pattern": F.col("owner").isNotNull() & ~F.col("owner").rlike(owner_pattern),
        "pii_retention_too_long": F.col("pii") & (days > max_pii_days),
        "retention_required": classification.isin(*NEEDS_RETENTION) & days.isNull(),
    }
    tag_rule = F.lit(False)
    for level, tags in required_tags.items():
        tag_rule = tag_rule | ((classification == level) & ~has_all_tags(F.col("tags"), tags))
    rules["required_tags"] = tag_rule
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return records.select("namespace", "name", F.explode(broken).alias("rule"))


def retention_status(records: DataFrame, as_of: Column, approaching_days: int = APPROACHING_DAYS) -> DataFrame:
    """Days left until a record's retention ends, negative when overdue; records without a limit are kept out."""
    left = F.col("retention_days") - F.date_diff(as_of, F.col("updated_at"))
    return (
        records.filter(F.col("retention_days").isNotNull())
        .withColumn("days_remaining", left)
        .withColumn(
            "retention_state",
            F.when(F.col("days_remaining") < 0, "overdue")
            .when(F.col("days_remaining") <= approaching_days, "approaching")
            .otherwise("ok"),
        )
    )


def expired(df: DataFrame, at: str, days: int, as_of: Column) -> Column:
    """Condition: the row is older than its retention."""
    return F.coalesce(F.date_diff(as_of, F.col(at)) > days, F.lit(False))


def split_expired(df: DataFrame, at: str, days: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, expired rows)."""
    gone = expired(df, at, days, as_of)
    return df.filter(~gone), df.filter(gone)
