"""Versioned tables: contents, and what a failure after every step leaves behind."""

import uuid
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weirgate.contracts import Contract
from weirgate.sources.versions import VersionedTable, refresh_versions, retain, retain_days

LEVELS = "station bigint, level double, river string"
FIRST = [(1, 2.5, "Isar"), (2, 0.25, "Loisach"), (3, None, "Isar"), (None, 9.0, None)]


class Stop(Exception):
    pass


class Steps:
    """Counts steps, and fails after the one that is asked for."""

    def __init__(self):
        self.seen, self.fail_at = 0, None

    def __call__(self, step):
        self.seen += 1
        if self.seen == self.fail_at:
            raise Stop(step)


@pytest.fixture
def make(spark, folder):
    made = []

    def table(partition_by=None, **kw):
        name = f"levels_{uuid.uuid4().hex}"
        made.append(name)
        return VersionedTable(spark, name, f"{folder}/{name}", partition_by, after=Steps(), **kw)

    yield table
    for name in made:
        spark.sql(f"DROP VIEW IF EXISTS {name}")
        for n in range(1, 40):
            spark.sql(f"DROP TABLE IF EXISTS {name}__v{n}")


def levels(spark, rows=FIRST):
    return spark.createDataFrame(rows, LEVELS)


def test_replace_append_and_older_versions(spark, make, rows):
    table = make()
    assert table.version() == 0 and table.parts() == []
    assert table.replace(levels(spark), "a") == 1
    assert table.append(levels(spark, [(9, 1.0, "Inn")]), "b") == 2
    assert rows(table.read()) == rows(levels(spark, [*FIRST, (9, 1.0, "Inn")]))
    assert table.append(levels(spark, [(9, 1.0, "Inn")]), "b") == 2  # the same run again
    assert table.replace(table.read().where("station = 9"), "c") == 3  # reads what it replaces
    assert rows(table.read()) == [(9, 1.0, "Inn")]
    assert rows(table.read(1)) == rows(levels(spark)) and table.version_of("b") == 2
    table.replace(levels(spark), "d")
    names = [p.name for p in Path(table.root, "data").iterdir()]
    assert sorted(names) == ["a", "b", "c", "d"]  # version 2 still holds a
    table.replace(levels(spark), "e")
    assert sorted(p.name for p in Path(table.root, "data").iterdir()) == ["c", "d", "e"]
    assert not spark.catalog.tableExists(f"{table.name}__v2")
    with pytest.raises(ValueError, match="run id"):
        table.replace(levels(spark), "../x")


def test_columns_may_change(spark, make):
    table = make()
    table.replace(levels(spark), "a")
    table.replace(levels(spark).select("river", F.lit(date(2024, 5, 1)).alias("day")), "b")
    assert table.read().dtypes == [("river", "string"), ("day", "date")]


def test_upsert_touches_only_its_partitions(spark, make, rows):
    table = make("river")
    table.replace(levels(spark, [*FIRST, (7, 7.0, "Würm's, 1/2 %+")]), "a")
    before = {p.value: p for p in table.parts()}
    changes = spark.createDataFrame([(1, 3.0, "Loisach", 1), (1, 4.0, "Loisach", 2), (None, 8.0, "Inn", 1), (7, 7.5, "Würm's, 1/2 %+", 1)], f"{LEVELS}, at int")
    table.upsert(changes, ["station"], [F.col("at").desc()], "b")
    wanted = [(1, 4.0, "Loisach"), (2, 0.25, "Loisach"), (3, None, "Isar"), (None, 8.0, "Inn"), (7, 7.5, "Würm's, 1/2 %+")]
    assert rows(table.read()) == rows(levels(spark, wanted))
    table.upsert(spark.createDataFrame([(8, 1.0, "Inn", 1)], f"{LEVELS}, at int"), ["station"], [F.col("at")], "c")
    after = {p.value: p for p in table.parts()}
    assert after["Isar"].run == "b" and after["Inn"].run == "c" and before["Isar"].run == "a"
    assert None not in after  # its only row has gone to another partition
    assert rows(table.read()) == rows(levels(spark, [*wanted, (8, 1.0, "Inn")]))


def test_partition_filters_reach_the_scan(spark, make):
    table = make("river")
    table.replace(levels(spark), "a")
    plan = table.read().where("river = 'Isar' AND level > 1")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(river" in plan and "PushedFilters: [IsNotNull(level), GreaterThan(level,1.0)]" in plan


def stepwise(rows, prepare, job):
    """Run a job with a failure after each of its steps, and then again; readers always find one of its states."""
    tables = prepare()
    before = [t.after.seen for t in tables]
    job(*tables)
    steps = [(i, k) for i, t in enumerate(tables) for k in range(1, t.after.seen - before[i] + 1)]
    assert len(steps) >= 5 * len(tables)
    wanted = [rows(t.read()) for t in tables]
    job(*tables)  # a second time changes nothing
    assert [rows(t.read()) for t in tables] == wanted
    for which, k in steps:
        tables = prepare()
        start, failing = rows(tables[0].read()), tables[which].after
        failing.fail_at = failing.seen + k
        with pytest.raises(Stop):
            job(*tables)
        assert rows(tables[0].read()) in (start, wanted[0])
        job(*tables)
        assert [rows(t.read()) for t in tables] == wanted
        for t in tables:
            used = {p.run for n in range(max(1, t.version() - t.keep + 1), t.version() + 1) for p in t.parts(n)}
            assert {p.name for p in Path(t.root, "data").iterdir()} <= used


def test_failed_replace(spark, make, rows):
    def prepare():
        table = make()
        table.replace(levels(spark), "a")
        return (table,)

    stepwise(rows, prepare, lambda t: t.replace(t.read().where("level > 1"), "b"))


def test_failed_upsert_of_partitions(spark, make, rows):
    changes = spark.createDataFrame([(1, 3.0, "Loisach", 1), (5, 4.0, "Inn", 2)], f"{LEVELS}, at int")

    def prepare():
        table = make("river")
        table.replace(levels(spark), "a")
        return (table,)

    stepwise(rows, prepare, lambda t: t.upsert(changes, ["station"], [F.col("at")], "b"))


DATED = "id int, at timestamp_ntz"


@pytest.fixture
def dated(spark):
    return spark.sql("SELECT id, CAST(concat('2024-01-0', id) AS timestamp_ntz) AS at FROM range(1, 9) UNION ALL SELECT 99, NULL").selectExpr("CAST(id AS int) AS id", "at")


def test_failed_archive(spark, make, rows, dated):
    def prepare():
        table, archive = make(), make()
        table.replace(dated, "load")
        return table, archive

    def job(table, archive):
        gone = retain(table, "at", 3, F.lit("2024-01-08").cast("date"), "nightly", "archive", archive)
        assert sorted(r.id for r in gone.collect()) == [1, 2, 3, 4]

    stepwise(rows, prepare, job)
    table, archive = prepare()
    job(table, archive)
    assert sorted(r.id for r in table.read().collect()) == [5, 6, 7, 8, 99]
    assert sorted(r.id for r in archive.read().collect()) == [1, 2, 3, 4]


def test_failed_archive_of_days(spark, make, rows, dated):
    by_day = dated.select("id", F.date_format("at", "yyyy-MM-dd").alias("day"))

    def prepare():
        table, archive = make("day"), make("day")
        table.replace(by_day, "load")
        return table, archive

    def job(table, archive):
        retain_days(table, 3, date(2024, 1, 8), "nightly", "archive", archive)

    stepwise(rows, prepare, job)
    table, archive = prepare()
    assert retain_days(table, 3, date(2024, 1, 8), "look", "notify") == [f"2024-01-0{i}" for i in range(1, 5)]
    job(table, archive)
    assert sorted(r.id for r in table.read().collect()) == [5, 6, 7, 8, 99]
    assert sorted(r.id for r in archive.read().collect()) == [1, 2, 3, 4]


def test_policies_are_checked(spark, make, dated):
    table = make()
    table.replace(dated, "load")
    as_of = F.lit("2024-01-08").cast("date")
    assert retain(table, "at", 3, as_of, "r", "notify").count() == 4 and table.read().count() == 9
    with pytest.raises(ValueError, match="unknown"):
        retain(table, "at", 3, as_of, "r", "shred")
    with pytest.raises(ValueError, match="archive"):
        retain(table, "at", 3, as_of, "r", "archive")


READING = Contract.from_dict({"name": "readings", "schema": [{"name": "station", "type": "bigint"}, {"name": "level", "type": "number"}, {"name": "note"}]})


def test_refresh_on_change_casts_and_writes_once(spark, make, rows):
    table = make()
    given = spark.createDataFrame([("7", 1), ("8", 2)], "station string, level int")

    def load(df, run, **kw):
        done = refresh_versions(table, READING, df, run, **kw)
        return done.loaded, done.rows

    assert load(None, "r0") == (False, 0) and load(given.limit(0), "r1") == (False, 0) and table.version() == 0
    assert load(given, "r2") == (True, 2)
    assert rows(table.read()) == [(7, 1.0, None), (8, 2.0, None)]
    assert table.read().dtypes == [("station", "bigint"), ("level", "double"), ("note", "string")]
    assert load(given.repartition(3), "r3") == (False, 0)
    assert load(given, "r2") == (False, 0)  # a run that was committed
    assert load(given, "r4", force=True) == (True, 2)
    assert load(given, "r5", profile="small") == (True, 2) and load(given, "r6") == (True, 2)
    assert load(None, "r7", clean=True) == (True, 0) and table.read().count() == 0
    assert {p.name for p in Path(table.root, "data").iterdir()} == {"r5", "r6", "r7"}


def test_failed_refresh(spark, make, rows):
    def prepare():
        table = make()
        refresh_versions(table, READING, spark.createDataFrame([(1, 1.0)], "station int, level double"), "a")
        return (table,)

    changed = spark.createDataFrame([(2, 1.5)], "station int, level double")
    stepwise(rows, prepare, lambda t: refresh_versions(t, READING, changed, "b"))
