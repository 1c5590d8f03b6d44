"""Ordered computations per key that stay balanced when one key holds most of the rows.

A plain window sends a whole key to one task. These helpers do not. The newest-N keeps only N rows per key and map
task before the shuffle. The running forms are scans in two levels: rows are dealt to spans of about equal size by
ranges of key and order, which Spark chooses from a sample of them, so a dense hour of one key is many spans and a
quiet year is part of one; every (key, span) is worked on by itself, and one row per span carries what the spans
before it add up to. The spans are written, so both levels see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weirgate.session import written

SPAN = "__span"


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in the given order, with their 1-based position as ``rank`` when named.

    ``order`` has to end in a unique column, so ties cannot change the result. The filter on the row
    number lets Spark drop all but ``n`` rows per key inside each map task (for ``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``).
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    name = rank or "__position"
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(name, position).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def spans(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = SPAN) -> DataFrame:
    """``df`` written in ranges of keys and order, numbered in that order in ``out``.

    Equal rows of keys and order are in one span, so ``order`` is to end in a unique column where many are equal.
    """
    return written(df.repartitionByRange(*keys, *order).withColumn(out, F.spark_partition_id()), "spans")


def running_total(df: DataFrame, keys: Sequence[str], at: str, amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over all rows of the key up to and including each instant.

    One row per key and instant: rows of the same instant are added up first. Each span starts with a row
    holding the sum of all spans before it, so no join is needed.
    """
    instants = spans(df.groupBy(*keys, at).agg(F.sum(amount).alias("__amount")), keys, (at,))
    before = W.partitionBy(*keys).orderBy(SPAN).rowsBetween(W.unboundedPreceding, -1)
    carried = instants.groupBy(*keys, SPAN).agg(F.sum("__amount").alias("__total")).select(
        *keys,
        F.lit(None).cast(df.schema[at].dataType).alias(at),
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__amount"),
        SPAN,
        F.lit(True).alias("__carry"),
    )
    inside = (
        W.partitionBy(*keys, SPAN).orderBy(F.col("__carry").desc(), at).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        instants.withColumn("__carry", F.lit(False)).unionByName(carried)
        .withColumn(out, F.sum("__amount").over(inside))
        .filter(~F.col("__carry"))
        .select(*keys, at, F.col("__amount").alias(amount), out)
    )


def previous_instant(df: DataFrame, keys: Sequence[str], at: str, out: str) -> DataFrame:
    """Distinct instants of each key with the instant before; NULL for the first.

    Each span starts with a copy of the last instant of the span before it.
    """
    instants = spans(df.select(*keys, at).distinct(), keys, (at,))
    over_spans = W.partitionBy(*keys).orderBy(SPAN)
    carried = (
        instants.groupBy(*keys, SPAN).agg(F.max(at).alias("__last"))
        .select(*keys, F.lag("__last").over(over_spans).alias(at), SPAN, F.lit(True).alias("__carry"))
        .filter(F.col(at).isNotNull())
    )
    inside = W.partitionBy(*keys, SPAN).orderBy(at)
    return (
        instants.withColumn("__carry", F.lit(False)).unionByName(carried)
        .withColumn(out, F.lag(at).over(inside))
        .filter(~F.col("__carry"))
        .select(*keys, at, out)
    )


def previous_value(df: DataFrame, keys: Sequence[str], at: str, tiebreak: str, value: str, out: str) -> DataFrame:
    """``value`` of the row before, in order of time and tiebreak, as a new column; NULL for the first row.

    Each span starts with a copy of the last row of the span before it. Rows of one instant are split by the
    tiebreak.
    """
    rows = spans(df, keys, (at, tiebreak))
    last = F.max_by(F.struct(at, tiebreak, value), F.struct(at, tiebreak))
    carried = (
        rows.groupBy(*keys, SPAN).agg(last.alias("__last"))
        .withColumn("__last", F.lag("__last").over(W.partitionBy(*keys).orderBy(SPAN)))
        .filter(F.col("__last").isNotNull())
        .select(*keys, SPAN, "__last.*", F.lit(True).alias("__carry"))
    )
    # a carried row comes first, also where its instant is that of the span's first row
    inside = W.partitionBy(*keys, SPAN).orderBy(F.col("__carry").desc(), at, tiebreak)
    return (
        rows.withColumn("__carry", F.lit(False)).unionByName(carried, allowMissingColumns=True)
        .withColumn(out, F.lag(value).over(inside))
        .filter(~F.col("__carry"))
        .drop(SPAN, "__carry")
    )
