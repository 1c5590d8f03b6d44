"""Refreshing an input table only when what feeds it has changed, and retention on files."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.contracts import Contract
from weirgate.operators.fingerprint import table_fingerprint
from weirgate.operators.governance import split_expired
from weirgate.session import written
from weirgate.sources.keyed import upsert
from weirgate.sources.readers import inline_rows, read_seed_file
from weirgate.sources.writers import create_if_absent, delete_path, path_exists, refresh_table, write_partitioned

META_SCHEMA = "table_name string, profile string, checksum string, seeded_at timestamp, loaded boolean"


@dataclass(frozen=True)
class Seed:
    """Rows or a file; inline rows win. ``profiles`` are named alternatives."""

    inline: tuple = ()
    file: str | None = None
    profiles: dict = field(default_factory=dict)


@dataclass
class RefreshResult:
    seeded: int = 0
    rows: int = 0
    skipped: int = 0


def seed_rows(spark: SparkSession, contract: Contract, seed: Seed, profile: str | None = None) -> DataFrame | None:
    """Rows of the chosen profile, or None when it has none. An unknown profile is an error."""
    chosen = seed
    if profile and seed.profiles:
        if profile not in seed.profiles:
            raise KeyError(f"profile {profile!r} not found (available: {', '.join(sorted(seed.profiles))})")
        chosen = seed.profiles[profile]
    if chosen.inline:
        return inline_rows(spark, list(chosen.inline), contract)
    if chosen.file:
        return read_seed_file(spark, chosen.file, contract)
    return None


def _meta(spark: SparkSession, path: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(META_SCHEMA).parquet(path)
    return spark.createDataFrame([], META_SCHEMA)


def refresh(
    spark: SparkSession,
    contract: Contract,
    rows: DataFrame | None,
    path: str,
    meta_path: str,
    profile: str = "default",
    force: bool = False,
    clean: bool = False,
) -> RefreshResult:
    """Load ``rows`` into the table at ``path`` unless they are what it already holds.

    The fingerprint is compared with the one stored for (table, profile), and the profile must be the one
    loaded last: going to another profile and back loads again. ``force`` loads regardless; ``clean``
    recreates the table, empty when there are no rows. Without rows and without ``clean`` nothing happens.
    """
    result = RefreshResult()
    if rows is None and not clean:
        return result
    data = rows if rows is not None else spark.createDataFrame([], contract.schema)
    if rows is not None and not clean and data.isEmpty():
        return result
    data = written(data, "seed")
    checksum = table_fingerprint(data, contract.locator, profile).first()["fingerprint"]
    meta = _meta(spark, meta_path)
    if not force and not clean:
        same = meta.filter(
            (F.col("table_name") == contract.locator) & (F.col("profile") == profile)
            & (F.col("checksum") == checksum) & F.col("loaded")
        )
        if path_exists(spark, path) and not same.isEmpty():
            result.skipped = 1
            return result
    create_if_absent(spark, path, contract)
    result.rows = refresh_table(data, path)
    result.seeded = 1
    entry = spark.createDataFrame([(contract.locator, profile, checksum, True)], "table_name string, profile string, checksum string, loaded boolean")
    entry = entry.withColumn("seeded_at", F.current_timestamp())
    others = meta.withColumn("loaded", F.col("loaded") & (F.col("table_name") != contract.locator))
    refresh_table(upsert(others, entry, ("table_name", "profile"), [F.col("seeded_at").desc()]), meta_path)
    return result


def apply_retention(
    df: DataFrame, path: str, at: str, days: int, as_of: Column, policy: str = "delete", archive_path: str | None = None
) -> DataFrame:
    """Apply a retention policy to the table ``df`` stored at ``path``; returns the expired rows.

    ``notify`` changes nothing. ``archive`` appends the expired rows to ``archive_path`` and checks their
    number there before the table is replaced by the kept rows. ``delete`` only replaces it.
    """
    if policy not in ("delete", "archive", "notify"):
        raise ValueError(f"unknown deletion policy {policy!r}")
    kept, gone = split_expired(df, at, days, as_of)
    gone = written(gone, "expired")
    if policy == "notify":
        return gone
    spark = df.sparkSession
    if policy == "archive":
        if not archive_path:
            raise ValueError("archive needs a path")
        before = spark.read.parquet(archive_path).count() if path_exists(spark, archive_path) else 0
        gone.write.mode("append").parquet(archive_path)
        if spark.read.parquet(archive_path).count() != before + gone.count():
            raise RuntimeError("archive is incomplete; nothing was removed")
    refresh_table(kept, path)
    return gone


def apply_partition_retention(
    spark: SparkSession, path: str, partition: str, days: int, as_of: date, policy: str = "delete", archive_path: str | None = None
) -> list[str]:
    """Retention of a table with one folder per day (``partition=YYYY-MM-DD``); the days that are past it.

    Whole folders are dropped, so no kept row is read or written. ``archive`` first appends the expired
    days to ``archive_path`` and checks their number there; ``notify`` changes nothing.
    """
    if policy not in ("delete", "archive", "notify"):
        raise ValueError(f"unknown deletion policy {policy!r}")
    table = spark.read.parquet(path)
    name = F.col(partition).cast("string")
    first_kept = (as_of - timedelta(days=days)).isoformat()
    days_held = table.where(name < first_kept).select(name).distinct()
    gone = sorted(r[0] for r in days_held.collect())  # one per folder; rows without a day never expire
    if policy == "notify" or not gone:
        return gone
    if policy == "archive":
        if not archive_path:
            raise ValueError("archive needs a path")
        expired = table.filter(name < first_kept)
        before = spark.read.parquet(archive_path).count() if path_exists(spark, archive_path) else 0
        write_partitioned(expired, archive_path, partition)
        if spark.read.parquet(archive_path).count() != before + expired.count():
            raise RuntimeError("archive is incomplete; nothing was removed")
    for day in gone:
        delete_path(spark, f"{path.rstrip('/')}/{partition}={day}")
    return gone
