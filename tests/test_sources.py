import json
from datetime import date
from pathlib import Path

import pytest

from weirgate.contracts import Contract
from weirgate.sources import readers as S
from weirgate.sources.custom import read_resolved

LEVELS = Contract.from_dict(
    {
        "name": "river_levels", "format": "csv",
        "schema": [
            {"name": "river"}, {"name": "level_m", "type": "number"}, {"name": "read_on", "type": "date"},
            {"name": "flooded", "type": "boolean"}, {"name": "sensor", "type": "bigint"},
        ],
    }
)


def write(folder, name, text):
    path = Path(folder) / name
    path.write_text(text)
    return str(path)


def test_csv(spark, folder, rows):
    text = "sensor,flooded,river,read_on,level_m\n9007199254740993,true,\"Inn, \"\"upper\"\"\",2024-02-29,-0.35\n,,,,\n12,FALSE,  Würm,not a day,1e2\n"
    found = rows(S.read_csv(spark, write(folder, "levels.csv", text), LEVELS))
    assert found == sorted(
        [('Inn, "upper"', -0.35, date(2024, 2, 29), True, 9007199254740993), (None,) * 5, ("  Würm", 100.0, None, False, 12)], key=repr
    )


@pytest.mark.parametrize("declared", [(), ("level_m",)])
def test_a_row_with_too_few_values_fails(spark, folder, declared):
    contract = Contract.from_dict({"name": "short", "schema": [{"name": n, "type": "number"} for n in declared]})
    df = S.read_csv(spark, write(folder, "short.csv", "level_m,river,sensor\n0.5,Isar,3\n0.75,Isar\n0.25,Inn,4\n"), contract)
    for action in (df.collect, df.count):
        with pytest.raises(Exception):
            action()


def test_a_csv_file_needs_a_header(spark, folder):
    with pytest.raises(Exception):
        S.read_csv(spark, write(folder, "nothing.csv", ""), LEVELS).collect()
    assert S.read_csv(spark, write(folder, "header.csv", "river,level_m\n"), LEVELS).count() == 0


def test_csv_values_are_text_without_a_contract(spark, folder):
    df = S.read_csv(spark, write(folder, "raw.csv", "sensor,read_on,flooded\n007,2024-01-31,true\n"), Contract("raw"))
    assert {kind for _, kind in df.dtypes} == {"string"} and df.first().asDict() == {"sensor": "007", "read_on": "2024-01-31", "flooded": "true"}


def test_json_array(spark, folder, rows):
    items = [
        {"river": "Isar", "level_m": 2, "flooded": None, "extra": [1, 2]}, {"sensor": 2**53 + 1, "read_on": "2023-12-31"}, {},
        {"river": "ü\"\\", "level_m": 0.1, "flooded": False},
    ]
    found = rows(S.read_seed_file(spark, write(folder, "levels.json", json.dumps(items, indent=2)), LEVELS))
    assert found == sorted(
        [("Isar", 2.0, None, None, None), (None, None, date(2023, 12, 31), None, 2**53 + 1), (None,) * 5, ('ü"\\', 0.1, None, False, None)], key=repr
    )


def test_unknown_seed_extension(spark):
    with pytest.raises(ValueError):
        S.read_seed_file(spark, "levels.yaml", LEVELS)


def test_inline_rows(spark, rows):
    given = [{"river": "Isar", "read_on": "2024-02-29", "level_m": 1}, {}, {"sensor": 5, "flooded": True, "unknown": "left out"}]
    assert rows(S.inline_rows(spark, given, LEVELS)) == sorted(
        [("Isar", 1.0, date(2024, 2, 29), None, None), (None,) * 5, (None, None, None, True, 5)], key=repr
    )


def test_missing_modules_are_named(spark, folder):
    with pytest.raises(RuntimeError, match="spark-avro"):
        S.read_files(spark, folder, Contract("a", format="avro"))
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        S.read_topic(spark, "localhost:1", Contract.from_dict({"name": "t", "topic": "t", "schema": [{"name": "a"}]}))
    with pytest.raises(ValueError):
        S.read_files(spark, folder, Contract("a", format="orc"))


def test_message_decoding(spark, rows):
    messages = [b'{"sensor": 4, "level_m": -1.5, "read_on": "2024-03-31"}', b"[1, 2", None, b'{"flooded": true, "sensor": null}']
    df = spark.createDataFrame([(m,) for m in messages], "value binary")
    found = rows(S.decode_json(df, LEVELS.schema).select("sensor", "level_m", "read_on", "flooded"))
    assert found == sorted([(4, -1.5, date(2024, 3, 31), None), (None,) * 4, (None,) * 4, (None, None, None, True)], key=repr)
    assert S.kafka_options("h:1", "t")["startingOffsets"] == "earliest"


def test_groups_keep_order_and_read_once():
    reads = []
    wanted = [Contract("b", table="public.b", store="s"), Contract("a", topic="a-topic", store="s"), Contract("b2", table="public.b", store="s")]
    frames = S.read_tables(wanted, lambda c: reads.append(c.name) or c.name)
    assert list(frames) == ["public.b", "a-topic"] and reads == ["b", "a"]
    with pytest.raises(ValueError):
        S.read_tables([Contract("x", store="s"), Contract("x", store="t")], lambda c: c.name)


def test_locator_order():
    assert Contract("n").locator == "n" and Contract("n", prefix="p/").locator == "p/"
    assert Contract("n", prefix="p/", topic="t").locator == "t" and Contract("n", topic="t", table="x").locator == "x"


def test_cells(spark, rows):
    made = {"c1": spark.createDataFrame([(1, "x")], "a int, b string"), "c2": spark.createDataFrame([(2,)], "a int")}
    assert rows(S.read_cells(made, made.get)) == [(1, "x", "c1"), (2, None, "c2")]
    with pytest.raises(ValueError):
        S.read_cells([], made.get)


def test_resolver_rows_and_batches(spark, rows):
    contract = Contract.from_dict(
        {"name": "r", "schema": [{"name": "id", "type": "string"}, {"name": "value", "type": "int64"}, {"name": "active", "type": "bool"}]}
    )

    def resolve(parent):
        for i in range(3):
            yield {"id": f"{parent}-{i}", "value": i}

    df = read_resolved(spark, contract, resolve, ["a", "b"])
    assert rows(df) == [(f"{p}-{i}", i, None) for p in "ab" for i in range(3)]
    assert df.rdd.getNumPartitions() == 2
