"""Casting rows to a contract, and reporting where they do not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.contracts.types import Contract, contract_type, is_known_type, null_column, spark_type


def _cast(name: str, actual: T.DataType, target: T.DataType, strict: bool) -> Column:
    column = F.col(f"`{name}`")
    if actual == target:
        return column
    return column.cast(target) if strict else column.try_cast(target)


def conform(df: DataFrame, contract: Contract, strict: bool = False) -> DataFrame:
    """Exactly the declared columns, in declared order and type.

    Absent columns become NULL and undeclared ones are dropped, whichever row they occur in. Values that
    do not cast become NULL, or fail the job when ``strict``.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for field in contract.schema.fields:
        if field.name in present:
            column = _cast(field.name, present[field.name], field.dataType, strict)
        else:
            column = null_column(field.dataType)
        columns.append(column.alias(field.name, metadata=field.metadata))
    return df.select(*columns)


def conformance_report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per column: expected and actual type, finding, and number of values that do not cast.

    Findings: ok, missing, extra, type_mismatch, unknown_type. The data is read once, and only the
    columns whose type differs.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    declared = {f.name: f for f in contract.fields}
    counts, rows = [], []

    def row(name: str, expected: str | None, actual: str | None, finding: str, bad: Column) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(expected).cast("string").alias("expected_type"),
            F.lit(actual).cast("string").alias("actual_type"),
            F.lit(finding).alias("finding"),
            bad.cast("bigint").alias("uncastable_values"),
        )

    for i, (name, field) in enumerate(declared.items()):
        if name not in present:
            rows.append(row(name, field.type, None, "missing", F.lit(0)))
            continue
        actual = contract_type(present[name])
        target = spark_type(field.type)
        if not is_known_type(field.type):
            rows.append(row(name, field.type, actual, "unknown_type", F.lit(0)))
        elif contract_type(target) == actual:
            rows.append(row(name, field.type, actual, "ok", F.lit(0)))
        else:
            column = F.col(f"`{name}`")
            counts.append(F.count_if(column.isNotNull() & column.try_cast(target).isNull()).alias(f"bad_{i}"))
            rows.append(row(name, field.type, actual, "type_mismatch", F.col(f"bad_{i}")))
    for name, data_type in present.items():
        if name not in declared:
            rows.append(row(name, None, contract_type(data_type), "extra", F.lit(0)))
    totals = df.agg(F.count(F.lit(1)).alias("row_count"), *counts)
    return totals.select(F.inline(F.array(*rows)))


def duplicate_fields(fields: DataFrame) -> DataFrame:
    """Empty and repeated field names per dataset, over the long table of declared columns."""
    return (
        fields.withColumn("name", F.coalesce("name", F.lit("")))
        .groupBy("dataset", "name")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter((F.col("occurrences") > 1) | (F.col("name") == ""))
        .withColumn("problem", F.when(F.col("name") == "", "empty").otherwise("duplicate"))
    )
