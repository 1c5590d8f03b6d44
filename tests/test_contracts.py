import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.contracts import Contract, conform, conformance_report, duplicate_fields, read_together, schema_diff, spark_type
from weirgate.contracts.types import contract_type, fields_table, foreign_type

USERS = Contract.from_dict(
    {
        "name": "users",
        "classification": "confidential",
        "schema": [
            {"name": "id", "type": "integer"},
            {"name": "email", "type": "string", "pii": True, "from": "raw.users.email"},
            {"name": "created_at", "type": "timestamp"},
        ],
    }
)


def test_types():
    assert spark_type("INTEGER") == T.IntegerType() and spark_type("INT64") == T.LongType()
    assert spark_type("long") == T.LongType() and spark_type("Number") == T.DoubleType()
    assert spark_type("geometry") == T.StringType() and spark_type("timestamp[us]") == T.TimestampType()
    assert foreign_type("BYTE_ARRAY") == "string" and foreign_type("int96") == "timestamp" and foreign_type("x") == "x"
    assert contract_type(T.ShortType()) == "integer" and contract_type(T.DecimalType(4, 1)) == "decimal(4,1)"


def test_metadata_survives_conforming(spark):
    df = conform(spark.createDataFrame([("7", "a@x", None, 1)], "id string, email string, created_at string, extra int"), USERS)
    assert df.columns == ["id", "email", "created_at"]
    assert df.schema["email"].metadata == {"pii": True, "from": "raw.users.email", "classification": "confidential"}
    assert df.first()["id"] == 7


def test_uncastable_values(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("99999999999",)], "id string")
    assert [r[0] for r in conform(df, USERS).select("id").collect()] == [1, None, None, None]
    with pytest.raises(Exception):
        conform(df, USERS, strict=True).collect()
    report = {r.column_name: (r.finding, r.uncastable_values) for r in conformance_report(df, USERS).collect()}
    assert report == {"id": ("type_mismatch", 2), "email": ("missing", 0), "created_at": ("missing", 0)}


def test_report_on_empty_table(spark):
    df = spark.createDataFrame([], "id string, other int")
    report = {r.column_name: r.finding for r in conformance_report(df, USERS).collect()}
    assert report == {"id": "type_mismatch", "email": "missing", "created_at": "missing", "other": "extra"}


def test_schema_diff(spark):
    old = spark.createDataFrame([("d", "a", "int"), ("d", "b", "string"), ("d", "c", None)], "dataset string, name string, type string")
    new = spark.createDataFrame([("d", "a", "bigint"), ("d", "n", "string"), ("d", "c", None)], "dataset string, name string, type string")
    got = {(r.name, r.change, r.breaking) for r in schema_diff(old, new).collect()}
    assert got == {("a", "type_changed", True), ("b", "field_removed", True), ("n", "field_added", False)}


def test_additive_versions(spark):
    v1, v2 = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert sorted(map(tuple, read_together(v1, v2).collect())) == [(1, None), (2, "x")]
    with pytest.raises(ValueError, match="removed"):
        read_together(v2, v1)
    with pytest.raises(ValueError, match="retyped"):
        read_together(v1, spark.createDataFrame([("1",)], "a string"))


def test_duplicate_fields(spark):
    twice = Contract.from_dict({"name": "t", "schema": [{"name": "a"}, {"name": "a"}, {"name": ""}, {"name": "b"}]})
    got = {(r.dataset, r.name, r.occurrences, r.problem) for r in duplicate_fields(fields_table(spark, [twice, USERS])).collect()}
    assert got == {("t", "a", 2, "duplicate"), ("t", "", 1, "empty")}
    assert fields_table(spark, [USERS]).filter(F.col("from_ref").isNotNull()).count() == 1
