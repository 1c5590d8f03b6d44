"""Contract type names and the contract itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared type names, matched without regard to case.
CONTRACT_TYPES = {
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "datetime": T.TimestampType(),
    "date": T.DateType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
}

# File-format and Arrow type names, matched exactly. 64-bit integers keep their width.
FOREIGN_TYPES = {
    "INT32": "integer",
    "int32": "integer",
    "INT64": "bigint",
    "int64": "bigint",
    "FLOAT": "float",
    "DOUBLE": "float",
    "BYTE_ARRAY": "string",
    "byte_array": "string",
    "UTF8": "string",
    "utf8": "string",
    "BOOLEAN": "boolean",
    "INT96": "timestamp",
    "int96": "timestamp",
    "TIMESTAMP_MILLIS": "timestamp",
    "TIMESTAMP_MICROS": "timestamp",
    "timestamp[us]": "timestamp",
    "timestamp[ms]": "timestamp",
}


def foreign_type(name: str) -> str:
    """Contract name of a file-format type; other names pass through."""
    return FOREIGN_TYPES.get(name, name)


def spark_type(name: str) -> T.DataType:
    """Spark type of a contract or file-format type name; unknown names are text."""
    return CONTRACT_TYPES.get(foreign_type(name).lower(), T.StringType())


def is_known_type(name: str) -> bool:
    return foreign_type(name).lower() in CONTRACT_TYPES


def contract_type(data_type: T.DataType) -> str:
    """Contract name of a Spark type."""
    if isinstance(data_type, (T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(data_type, T.LongType):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.StringType):
        return "string"
    return data_type.simpleString()


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    pii: bool = False
    source: str | None = None


@dataclass(frozen=True)
class Contract:
    """One dataset: where it lives and what its columns are.

    Exactly one of ``table``, ``prefix`` and ``topic`` locates it; with none, its own name does.
    """

    name: str
    fields: tuple[Field, ...] = ()
    format: str = "parquet"
    table: str | None = None
    prefix: str | None = None
    topic: str | None = None
    classification: str | None = None
    store: str | None = None
    cell: str | None = None
    labels: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, spec: dict) -> Contract:
        fields = tuple(
            Field(f["name"], f.get("type", "string"), bool(f.get("pii", False)), f.get("from"))
            for f in spec.get("schema", ())
        )
        keep = ("format", "table", "prefix", "topic", "classification", "store", "cell", "labels")
        return cls(name=spec["name"], fields=fields, **{k: spec[k] for k in keep if spec.get(k) is not None})

    @property
    def locator(self) -> str:
        return self.table or self.topic or self.prefix or self.name

    @property
    def schema(self) -> T.StructType:
        """Spark schema whose field metadata carries the personal-data flag and column lineage."""
        columns = []
        for f in self.fields:
            metadata = {"pii": f.pii}
            if f.source:
                metadata["from"] = f.source
            if self.classification:
                metadata["classification"] = self.classification
            columns.append(T.StructField(f.name, spark_type(f.type), True, metadata))
        return T.StructType(columns)


def fields_table(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """Long table of declared columns, one row per (dataset, field): input of the lineage operators."""
    rows = [
        (c.name, i, f.name, f.type, f.pii, f.source, c.classification)
        for c in contracts
        for i, f in enumerate(c.fields)
    ]
    return spark.createDataFrame(
        rows,
        "dataset string, position int, name string, type string, pii boolean, from_ref string, classification string",
    )


def empty_frame(spark: SparkSession, contract: Contract) -> DataFrame:
    return spark.createDataFrame([], contract.schema)


def null_column(data_type: T.DataType):
    return F.lit(None).cast(data_type)
