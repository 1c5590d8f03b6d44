"""Writing tables: append, refresh, recreate, partitioned files, fan-out and sync summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirgate.contracts import Contract, conform
from weirgate.contracts.types import empty_frame
from weirgate.session import written

# Parquet codecs a store may name.
COMPRESSIONS = ("snappy", "gzip", "zstd")


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _file_system(spark, path)
    return fs.exists(jvm_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _file_system(spark, path)
    return fs.exists(jvm_path) and fs.getFileStatus(jvm_path).isDirectory()


def rename_path(spark: SparkSession, path: str, new: str) -> None:
    fs, jvm_path = _file_system(spark, path)
    if not fs.rename(jvm_path, _file_system(spark, new)[1]):
        raise RuntimeError(f"could not rename {path} to {new}")


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _file_system(spark, path)
    fs.delete(jvm_path, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it does not exist."""
    fs, jvm_path = _file_system(spark, path)
    if not fs.exists(jvm_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jvm_path) if s.isDirectory())


def append_files(df: DataFrame, prefix: str, table: str, file_format: str = "parquet", run: str | None = None) -> str:
    """Append new files below ``prefix/table``; every table has its own format. Texts keep the microseconds of times.

    With ``run`` the files go to a folder of that run, in place of what an earlier attempt of it has left there: a
    run that is repeated after a failure appends its rows once. Readers find the run in a column of that name.
    """
    path = f"{prefix.rstrip('/')}/{table}"
    writer = df.write.mode("overwrite" if run else "append").format(file_format)
    if file_format in ("json", "csv"):
        exact = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
        writer = writer.option("timestampNTZFormat", exact).option("timestampFormat", f"{exact}[XXX]")
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(f"{path}/run={run}" if run else path)
    return path


def write_single_file(df: DataFrame, prefix: str, table: str, file_format: str = "json") -> str:
    """One unrotated file per table, replaced on every write. One task writes it: for small outputs only."""
    path = f"{prefix.rstrip('/')}/{table}"
    df.coalesce(1).write.mode("overwrite").format(file_format).save(path)
    return path


def write_partitioned(
    df: DataFrame, path: str, partition_by: str, compression: str = "snappy", mode: str = "append", rebalance: bool = True
) -> None:
    """Compressed parquet with one folder per partition value.

    Rows are rebalanced by value first: AQE joins small values into one task and splits a value holding
    most rows over many, so files come out in a good size either way. Turn that off for input already
    ordered by the value. With ``mode='overwrite'`` only the folders present in ``df`` are replaced.
    """
    if compression not in COMPRESSIONS:
        raise ValueError(f"compression must be one of {COMPRESSIONS}")
    (
        (df.hint("rebalance", partition_by) if rebalance else df)
        .write.mode(mode)
        .option("compression", compression)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .parquet(path)
    )


def refresh_table(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    """Replace all rows of a parquet folder: write beside it, check the number of rows, then swap.

    Between the two renames readers find no folder; a table with readers is a
    :class:`~weirgate.sources.versions.VersionedTable`. ``df`` may read the same path. The old files go only once the new ones are in place; a failure before
    that leaves them as they were.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    base = path.rstrip("/")
    staged, old = f"{base}.staged-{tag}", f"{base}.old-{tag}"
    observed = Observation()
    writer = df.observe(observed, F.count(F.lit(1)).alias("rows")).write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(staged)
    expected = observed.get["rows"]
    if spark.read.schema(df.schema).parquet(staged).count() != expected:
        raise RuntimeError(f"staged rows differ from the {expected} computed ones; {path} left as it was")
    had_old = path_exists(spark, base)
    if had_old:
        rename_path(spark, base, old)
    try:
        rename_path(spark, staged, base)
    except Exception:
        if had_old:
            rename_path(spark, old, base)
        raise
    if had_old:
        delete_path(spark, old)
    return expected


def recreate_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Drop and create a catalog table from the rows, schema included; at ``path`` when given."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def create_if_absent(spark: SparkSession, path: str, contract: Contract) -> bool:
    """Create an empty table of the declared columns; an existing one is left alone."""
    if path_exists(spark, path):
        return False
    empty_frame(spark, contract).write.parquet(path)
    return True


def append_relational(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None) -> None:
    """Append to a warehouse table over JDBC. Every partition writes through its own connection."""
    df.write.format("jdbc").mode("append").options(**dict(properties or {}), url=url, dbtable=table).save()


def refresh_relational(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None) -> None:
    """Empty the warehouse table, keeping it and its columns, then insert."""
    options = dict(properties or {}, url=url, dbtable=table, truncate="true")
    df.write.format("jdbc").mode("overwrite").options(**options).save()


def fan_out(
    tables: Mapping[str, DataFrame], destinations: Mapping[str, Callable[[str, DataFrame], None]], parallel: int = 4
) -> DataFrame:
    """Write every table to every destination; returns the sync summary.

    A table that goes to several destinations is staged once, so its source is read once. A failed write
    is counted for its table and the others go on. Up to ``parallel`` tables are written side by side.
    """
    spark = SparkSession.active()

    def sync(item: tuple[str, DataFrame]) -> list[tuple]:
        name, df = item
        observed, rows = Observation(), []
        source = df.observe(observed, F.count(F.lit(1)).alias("rows"))
        try:
            if len(destinations) > 1:
                source = written(source, "fanout")
        except Exception as error:
            return [(name, d, 0, 1, str(error)) for d in destinations]
        for destination, write in destinations.items():
            try:
                write(name, source)
                rows.append((name, destination, observed.get["rows"], 0, None))
            except Exception as error:
                rows.append((name, destination, 0, 1, str(error)))
        return rows

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        summary = [row for rows in pool.map(inheritable_thread_target(spark)(sync), tables.items()) for row in rows]
    return spark.createDataFrame(
        summary, "table_name string, destination string, rows_written bigint, errors int, error_message string"
    )


def save_contract(df: DataFrame, contract: Contract, prefix: str) -> str:
    """Cast to the contract and append in its own format."""
    return append_files(conform(df, contract), prefix, contract.locator, contract.format)


def append_events(events: DataFrame, logs: Sequence[Callable[[DataFrame], None]]) -> list[Exception]:
    """Append lineage or run events to every log. A failing log does not stop the others; errors are returned."""
    errors: list[Exception] = []
    for write in logs:
        try:
            write(events)
        except Exception as error:
            errors.append(error)
    return errors


def save_model(
    df: DataFrame, table: str, cluster_by: Iterable[str] = (), buckets: int = 0, path: str | None = None
) -> DataFrame:
    """Materialise a model as a catalog table, bucketed when later joins should find it already shuffled."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    columns = list(cluster_by)
    if columns and buckets:
        writer = writer.bucketBy(buckets, *columns).sortBy(*columns)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
