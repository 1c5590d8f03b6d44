"""Changes to keyed tables kept as plain files: upsert, create, update, delete, and change logs.

A changed table is computed as current rows without the changed keys, plus the newest version of each
changed key. The changes are usually the small side, so Spark broadcasts their keys and the current
table is read and written without a shuffle. Changes are written to the scratch folder first, so they are
evaluated once. A NULL key equals a NULL key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.operators.windows import newest
from weirgate.session import written
from weirgate.sources.writers import delete_path, write_partitioned

# What a change may do.
LOG_OPERATIONS = ("insert", "create", "update", "delete")
OPERATIONS = ("create", "update", "delete")


def matching(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows of ``left`` with (``left_semi``) or without (``left_anti``) an equal key in ``right``."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return left.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Changed rows replace those of the same key. Among changes of one key the first in ``order`` wins.

    As a plain table the size of the winning changes is known and Spark can split the join where a key has many
    rows.
    """
    columns = [*current.columns, *_extra(changes, current)]
    latest = written(newest(changes.select(*columns), keys, order).select(*current.columns), "changes")
    return matching(current, latest, keys, "left_anti").unionByName(latest)


def _extra(changes: DataFrame, current: DataFrame) -> list[str]:
    return [c for c in changes.columns if c not in current.columns]


def apply_change_log(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], position: str = "position", operation: str = "op"
) -> DataFrame:
    """Table after a log of inserts, updates and deletes: the last change of a key wins, a delete drops it.

    A change whose operation is NULL or none of ``LOG_OPERATIONS`` fails the job, in the pass that reads the log.
    """
    op = F.col(operation)
    wrong = F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op.cast("string"), F.lit("NULL"))))
    checked = changes.withColumn(operation, F.when(op.isin(*LOG_OPERATIONS), op).otherwise(wrong))
    latest = written(newest(checked, keys, [F.col(position).desc()]), "changes")
    alive = latest.filter(op != "delete")
    return matching(current, latest, keys, "left_anti").unionByName(alive.select(*current.columns))


def rejected_changes(current: DataFrame, changes: DataFrame, keys: Sequence[str], operation: str = "op") -> DataFrame:
    """Changes that cannot apply, with the reason: an operation that is NULL or unknown, a create of a known key,
    or an update or delete of an unknown one. The current table is read once, its keys only."""
    return _rejected(current, written(changes, "changes"), keys, operation)


def _rejected(current: DataFrame, changes: DataFrame, keys: Sequence[str], operation: str) -> DataFrame:
    known = matching(current.select(*keys), changes, keys, "left_semi").distinct()
    marked = known.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__known"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    op, found = F.col(operation), F.col("__known").isNotNull()
    reason = (
        F.when(op.isNull() | ~op.isin(*OPERATIONS), "unknown operation")
        .when((op == "create") & found, "already exists")
        .when((op != "create") & ~found, "not found")
    )
    return changes.join(marked, same, "left").select(*changes.columns, reason.alias("reason")).filter("reason IS NOT NULL")


def apply_changes(current: DataFrame, changes: DataFrame, keys: Sequence[str], operation: str = "op") -> DataFrame:
    """Create, update and delete rows by key, one change per key; fails when any change cannot apply."""
    changes = written(changes, "changes")
    repeated = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        raise ValueError("more than one change for a key")
    first = _rejected(current, changes, keys, operation).select(*keys, operation, "reason").take(1)
    if first:
        raise ValueError(f"change cannot apply: {first[0].asDict()}")
    alive = changes.filter(F.col(operation) != "delete")
    return matching(current, changes, keys, "left_anti").unionByName(alive.select(*current.columns))


def partitions_in(partition: str, values: list) -> Column:
    """Rows of these partitions, as a filter that Spark prunes folders by."""
    inside = F.col(partition).isin(*[v for v in values if v is not None])
    return inside | F.col(partition).isNull() if None in values else inside


def upsert_partitions(path: str, changes: DataFrame, keys: Sequence[str], order: Sequence[Column], partition: str) -> None:
    """Upsert into partitioned parquet files, rewriting only the partitions a changed key is or was in.

    Finding those reads the key columns of the whole table; then only their folders are read. The new partitions
    are staged first: the table is never overwritten while it is being read. A partition that loses its last row
    loses its folder. The driver holds the partition values, as it does for the file listing.
    """
    spark = changes.sparkSession
    current = spark.read.parquet(path)
    latest = written(newest(changes, keys, order).select(*current.columns), "changes")
    places = matching(current.select(*dict.fromkeys((*keys, partition))), latest, keys, "left_semi").select(partition)
    touched = [r[0] for r in places.unionByName(latest.select(partition)).distinct().collect()]
    affected = current.filter(partitions_in(partition, touched))
    result = written(matching(affected, latest, keys, "left_anti").unionByName(latest), "staged")
    filled = {r[0] for r in result.select(partition).distinct().collect()}
    emptied = [v for v in touched if v not in filled]
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    gone = [r[0] for r in current.filter(partitions_in(partition, emptied)).select(folder).distinct().collect()] if emptied else []
    write_partitioned(result, path, partition, mode="overwrite")
    for old in gone:
        delete_path(spark, unquote(old))
