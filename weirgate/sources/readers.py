"""Reading contracts: files, inline rows, relational tables, topics, groups and cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.contracts import Contract, conform

# File formats a contract may name.
FILE_FORMATS = ("parquet", "json", "csv", "avro")


def read_files(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Files of the contract's format, with its schema when it declares one.

    CSV takes its column names from the first row, reads every value as text, fails on a ragged row and
    is cast to the contract afterwards. JSON has one object per line.
    """
    if contract.format not in FILE_FORMATS:
        raise ValueError(f"{contract.name}: unsupported format {contract.format!r}")
    if contract.format == "csv":
        return read_csv(spark, path, contract)
    reader = spark.read.format(contract.format)
    if contract.fields and contract.format != "parquet":
        reader = reader.schema(contract.schema)
    try:
        df = reader.load(path)
    except Exception as error:
        if contract.format == "avro" and "Failed to find data source" in str(error):
            raise RuntimeError("avro files need the spark-avro module on the class path") from error
        raise
    return conform(df, contract) if contract.fields else df


def read_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
    # Every column is text, named by the header. Without pruning the parser sees whole rows, so a ragged
    # one fails even when only some columns are used.
    df = reader.option("inferSchema", False).option("columnPruning", False).csv(path)
    if not df.columns:
        raise ValueError(f"{contract.name}: CSV file has no header")
    return conform(df, contract) if contract.fields else df


def read_json_array(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Files that each hold one JSON array of objects. Such a file cannot be split: meant for seed files."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if contract.fields:
        reader = reader.schema(contract.schema)
    df = reader.json(path)
    return conform(df, contract) if contract.fields else df


def read_seed_file(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Seed file by extension; anything but .csv and .json is an error."""
    lowered = path.lower()
    if lowered.endswith(".csv"):
        return read_csv(spark, path, contract)
    if lowered.endswith(".json"):
        return read_json_array(spark, path, contract)
    raise ValueError(f"unsupported seed file {path!r}: use .csv or .json")


def inline_rows(spark: SparkSession, rows: list[dict], contract: Contract) -> DataFrame:
    """Rows written in the contract itself. Values travel as given and are cast to the declared types."""
    names = [f.name for f in contract.fields] or sorted({k for r in rows for k in r})
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    values = [tuple(_text(r.get(n)) for n in names) for r in rows]
    df = spark.createDataFrame(values, text)
    return conform(df, contract) if contract.fields else df


def _text(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def read_relational(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """Relational table over JDBC. Filters and columns are pushed to the database by Spark.

    Give ``partition_column`` and ``bounds`` for anything large, so that many tasks read it.
    """
    options = dict(properties or {}, url=url, dbtable=table)
    if partition_column:
        low, high = bounds if bounds else _column_bounds(spark, options, partition_column)
        if low is not None:
            options |= {
                "partitionColumn": partition_column,
                "lowerBound": str(low),
                "upperBound": str(high),
                "numPartitions": str(partitions),
            }
    return spark.read.format("jdbc").options(**options).load()


def _column_bounds(spark: SparkSession, options: dict, column: str) -> tuple[object, object]:
    row = spark.read.format("jdbc").options(**options).load().agg(F.min(column), F.max(column)).first()
    return row[0], row[1]


def kafka_options(servers: str, topic: str, starting: str = "earliest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Columns of a JSON message value; malformed messages give NULL columns."""
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*")


def read_topic(spark: SparkSession, servers: str, contract: Contract) -> DataFrame:
    """All messages present in a topic now, from the earliest offset, decoded with the contract."""
    try:
        raw = spark.read.format("kafka").options(**kafka_options(servers, contract.locator)).load()
    except Exception as error:
        if "Failed to find data source" in str(error):
            raise RuntimeError("topics need the spark-sql-kafka module on the class path") from error
        raise
    return decode_json(raw, contract.schema)


def read_tables(contracts: Iterable[Contract], read: Callable[[Contract], DataFrame]) -> dict[str, DataFrame]:
    """One DataFrame per contract of a sync or a group, keyed by its locator, in input order.

    Contracts that share a store and locator are read once.
    """
    frames: dict[str, DataFrame] = {}
    owners: dict[str, str | None] = {}
    for c in contracts:
        if c.locator in frames:
            if owners[c.locator] != c.store:
                raise ValueError(f"{c.locator!r} occurs in stores {owners[c.locator]!r} and {c.store!r}")
            continue
        frames[c.locator] = read(c)
        owners[c.locator] = c.store
    return frames


def read_cells(cells: Iterable[str], read: Callable[[str], DataFrame]) -> DataFrame:
    """The same dataset from several cells, as one table with a ``cell`` column."""
    frames = [read(cell).withColumn("cell", F.lit(cell)) for cell in cells]
    if not frames:
        raise ValueError("no cells given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
