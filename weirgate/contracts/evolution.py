"""Comparing schema versions and reading additive versions together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Field changes between two versions of long field tables (keys, name, type).

    A removed field or a changed type is breaking; an added field is not.
    """
    on = [*keys, "name"]
    before = old.select(*on, F.col("type").alias("old_type"), F.lit(True).alias("in_old"))
    after = new.select(*on, F.col("type").alias("new_type"), F.lit(True).alias("in_new"))
    change = (
        F.when(F.col("in_new").isNull(), "field_removed")
        .when(F.col("in_old").isNull(), "field_added")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "type_changed")
    )
    return (
        before.join(after, on, "full")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(*on, "old_type", "new_type", "change", (F.col("change") != "field_added").alias("breaking"))
    )


def breaking_changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    return schema_diff(old, new, keys).filter("breaking")


def read_together(*versions: DataFrame) -> DataFrame:
    """Union of additive versions, oldest first; columns a version lacks are NULL.

    Raises when a later version drops or retypes a column of an earlier one.
    """
    seen: dict[str, str] = {}
    for i, version in enumerate(versions):
        types = dict(version.dtypes)
        gone = sorted(set(seen) - set(types))
        changed = sorted(n for n in set(seen) & set(types) if seen[n] != types[n])
        if gone or changed:
            raise ValueError(f"version {i} is not additive: removed {gone}, retyped {changed}")
        seen = types
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)
