"""Profiles, model tests, and sync summaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.operators.fingerprint import canonical

NULL_RATE = "null_rate_"


def profile(df: DataFrame, freshness: str | None = None) -> DataFrame:
    """Row count, share of NULLs per column and newest value of the freshness column, in one pass."""
    total = F.count(F.lit(1))
    rates = [
        (F.count_if(F.col(f"`{c}`").isNull()).cast("double") / total).alias(NULL_RATE + c) for c in df.columns
    ]
    newest = F.max(freshness) if freshness else F.max(F.lit(None).cast(T.TimestampType()))
    return df.agg(total.alias("row_count"), newest.alias("freshness"), *rates)


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a path. Only the listing is read, not the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def null_violations(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows (column_name, test, violations) of NULLs per column; all columns in one pass."""
    columns = list(columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit("not_null").alias("test"), F.col(f"v{i}").alias("violations"))
        for i, c in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*rows)))


def unique_violations(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows (column_name, test, violations): values that occur more than once, per column; NULLs do not count.

    The table is read once and shuffled once for all columns: each row gives one (column, digest of the value) for
    each of them, which combine before the shuffle. The digest is SHA-256 of the value's canonical text, so two
    values are taken for one only if their digests collide.
    """
    columns = list(columns)
    kinds = {f.name: f.dataType for f in df.schema}
    values = [F.struct(F.lit(c).alias("column_name"), F.unhex(F.sha2(canonical(F.col(f"`{c}`"), kinds[c]), 256)).alias("value")) for c in columns]
    stacked = df.select(F.inline(F.array(*values))).filter("value IS NOT NULL")
    counted = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy("column_name").agg(F.count_if(F.col("n") > 1).alias("violations"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    # a column without values has no row there
    return named.join(found, "column_name", "left").select(
        "column_name", F.lit("unique").alias("test"), F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")
    )


def model_tests(df: DataFrame, tests: Mapping[str, Iterable[str]]) -> DataFrame:
    """Violations per column and test, zero where a test holds. Tests are ``not_null`` and ``unique``."""
    wanted = {c: list(t) for c, t in tests.items()}
    unknown = {t for ts in wanted.values() for t in ts} - {"not_null", "unique"}
    if unknown:
        raise ValueError(f"unknown tests: {sorted(unknown)}")
    required = [c for c, t in wanted.items() if "not_null" in t]
    single = [c for c, t in wanted.items() if "unique" in t]
    parts = [null_violations(df, required)] if required else []
    parts += [unique_violations(df, single)] if single else []
    return reduce(lambda a, b: a.unionByName(b), parts)


def column_profile(df: DataFrame) -> DataFrame:
    """One row a column, of all columns, in one pass: ``column_name``, ``type``, ``row_count``, ``nulls``,
    ``null_rate``, ``bytes``, ``least``, ``greatest``, ``approx_distinct`` and ``approx_median``.

    ``bytes`` adds up the lengths of the values' canonical texts in UTF-8; ``least`` and ``greatest`` are texts of
    values that can be ordered. Distinct values are estimated by a HyperLogLog sketch of 4096 registers (within
    about 2 %), the median of a number by a KLL sketch of at most 64 KB. Both merge, so partial results combine
    before the shuffle and nothing grows with the rows.
    """
    total, rows = F.count(F.lit(1)), []
    measures = [total.alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        text = canonical(c, f.dataType)
        ordered = isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)
        number = isinstance(f.dataType, T.NumericType)
        sketch = F.kll_sketch_agg_double(F.when(~F.isnan(c.cast("double")), c.cast("double"))) if number else F.max(F.lit(None).cast("binary"))
        none = F.max(F.lit(None).cast("string"))
        measures += [
            F.count(c).alias(f"n{i}"),
            F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0)).alias(f"b{i}"),
            (F.min(c).cast("string") if ordered else none).alias(f"l{i}"),
            (F.max(c).cast("string") if ordered else none).alias(f"g{i}"),
            F.hll_sketch_agg(text, 12).alias(f"h{i}"),
            sketch.alias(f"k{i}"),
        ]
        held = F.col(f"n{i}") > 0
        median = F.when(held, F.kll_sketch_get_quantile_double(F.col(f"k{i}"), F.lit(0.5))) if number else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("__rows").alias("row_count"),
                (F.col("__rows") - F.col(f"n{i}")).alias("nulls"),
                F.when(F.col("__rows") > 0, (F.col("__rows") - F.col(f"n{i}")).cast("double") / F.col("__rows")).alias("null_rate"),
                F.col(f"b{i}").alias("bytes"),
                F.col(f"l{i}").alias("least"),
                F.col(f"g{i}").alias("greatest"),
                F.hll_sketch_estimate(f"h{i}").alias("approx_distinct"),
                median.alias("approx_median"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*rows)))
