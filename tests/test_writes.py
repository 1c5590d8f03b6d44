import random
import re
from datetime import date, datetime
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weirgate.contracts import Contract
from weirgate.operators import fingerprint as P
from weirgate.sources import keyed
from weirgate.sources import refresh as D
from weirgate.sources import writers as K

SLUICES = Contract.from_dict(
    {"name": "sluices", "schema": [{"name": "river"}, {"name": "gates", "type": "bigint"}, {"name": "width_m", "type": "number"}, {"name": "built", "type": "date"}]}
)


def posts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, name string")


def test_create_if_absent(spark, folder):
    path = f"{folder}/t"
    assert K.create_if_absent(spark, path, SLUICES) and not K.create_if_absent(spark, path, SLUICES)
    found = spark.read.parquet(path)
    assert found.count() == 0 and found.dtypes == [("river", "string"), ("gates", "bigint"), ("width_m", "double"), ("built", "date")]


def test_append_keeps_earlier_files(spark, folder, rows):
    for i in range(2):
        path = K.append_files(posts(spark, (i, "x")), folder, "t")
    assert rows(spark.read.parquet(path)) == [(0, "x"), (1, "x")]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_a_repeated_run_appends_once(spark, folder, rows, kind):
    for run, value in (("a", 1), ("b", 2), ("b", 2), ("a", 3)):
        path = K.append_files(posts(spark, (value, "x"), (value, "y")), folder, "t", kind, run=run)
    back = spark.read.schema("id int, name string, run string").format(kind).load(path)
    assert rows(back) == [(2, "x", "b"), (2, "y", "b"), (3, "x", "a"), (3, "y", "a")]


def test_single_file(spark, folder):
    path = K.write_single_file(posts(spark, *[(i, "x") for i in range(50)]).repartition(5), folder, "t")
    assert len(list(Path(path).glob("part-*"))) == 1


def test_refresh_may_read_what_it_replaces(spark, folder, rows):
    path = f"{folder}/t"
    posts(spark, (1, "a"), (2, "b")).write.parquet(path)
    assert K.refresh_table(spark.read.parquet(path).filter("id > 1"), path) == 1
    assert rows(spark.read.parquet(path)) == [(2, "b")]
    assert [p.name for p in Path(folder).iterdir()] == ["t"]


def test_failed_refresh_leaves_the_table(spark, folder, rows):
    path = f"{folder}/t"
    posts(spark, (1, "a")).write.parquet(path)
    bad = spark.read.parquet(path).withColumn("id", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        K.refresh_table(bad, path)
    assert rows(spark.read.parquet(path)) == [(1, "a")]


def test_partitioned_overwrite_touches_only_its_days(spark, folder, rows):
    path = f"{folder}/t"
    df = spark.createDataFrame([(1, "d1"), (2, "d2")], "id int, day string")
    K.write_partitioned(df, path, "day", "zstd")
    K.write_partitioned(spark.createDataFrame([(9, "d2")], "id int, day string"), path, "day", mode="overwrite")
    assert rows(spark.read.parquet(path)) == [(1, "d1"), (9, "d2")]
    with pytest.raises(ValueError):
        K.write_partitioned(df, path, "day", "lzo")


def test_fan_out_counts_failures(spark, folder):
    def broken(name, df):
        raise OSError("disk")

    df = posts(spark, (1, "a"), (2, "b"))
    summary = K.fan_out({"t": df, "u": df}, {"lake": lambda n, x: K.append_files(x, folder, n), "bad": broken})
    got = {(r.table_name, r.destination): (r.rows_written, r.errors) for r in summary.collect()}
    assert got == {(t, d): v for t in "tu" for d, v in (("lake", (2, 0)), ("bad", (0, 1)))}


def test_event_logs_are_independent(spark, folder):
    def broken(df):
        raise OSError("disk")

    events = spark.createDataFrame([("r", "START")], "run_id string, event_type string")
    errors = K.append_events(events, [broken, lambda df: K.append_files(df, folder, "log")])
    assert len(errors) == 1 and spark.read.parquet(f"{folder}/log").count() == 1


def test_upsert(spark, rows):
    current = posts(spark, (1, "a"), (2, "b"))
    changes = spark.createDataFrame([(2, "new", 5), (2, "newer", 6), (3, "c", 1)], "id int, name string, at int")
    assert rows(keyed.upsert(current, changes, ["id"], [F.col("at").desc()])) == [(1, "a"), (2, "newer"), (3, "c")]


def test_change_log(spark, rows):
    current = posts(spark, (1, "a"), (2, "b"))
    log = [(1, "x", 1, "update"), (1, "y", 3, "delete"), (1, "z", 2, "update"), (4, "d", 4, "insert"), (2, "q", 9, "update")]
    changes = spark.createDataFrame(log, "id int, name string, position int, op string")
    assert rows(keyed.apply_change_log(current, changes, ["id"])) == [(2, "q"), (4, "d")]


@pytest.mark.parametrize("op", [None, "bogus"])
def test_change_log_rejects_unknown_operations(spark, op):
    changes = spark.createDataFrame([(1, "x", 1, op), (1, "y", 2, "update")], "id int, name string, position int, op string")
    with pytest.raises(Exception, match="unknown operation"):
        keyed.apply_change_log(posts(spark, (1, "a")), changes, ["id"])


def test_null_keys_are_one_key(spark, rows):
    current = posts(spark, (1, "a"), (None, "old"))
    changes = spark.createDataFrame([(None, "new", 5)], "id int, name string, at int")
    assert rows(keyed.upsert(current, changes, ["id"], [F.col("at").desc()])) == [(1, "a"), (None, "new")]
    gone = spark.createDataFrame([(None, None, "delete")], "id int, name string, op string")
    assert rows(keyed.apply_changes(current, gone, ["id"])) == [(1, "a")]


def test_keyed_changes(spark, rows):
    current = posts(spark, (1, "a"), (2, "b"))

    def changes(*given):
        return spark.createDataFrame(list(given), "id int, name string, op string")

    good = changes((1, "x", "update"), (2, None, "delete"), (3, "c", "create"))
    assert rows(keyed.apply_changes(current, good, ["id"])) == [(1, "x"), (3, "c")]
    for bad, reason in (((1, "x", "create"), "already exists"), ((9, "x", "update"), "not found"), ((9, None, "delete"), "not found"),
                        ((2, None, None), "unknown operation"), ((7, "x", "bogus"), "unknown operation")):
        with pytest.raises(ValueError, match=reason):
            keyed.apply_changes(current, changes(bad), ["id"])
    with pytest.raises(ValueError, match="more than one"):
        keyed.apply_changes(current, changes((1, "x", "update"), (1, "y", "update")), ["id"])


def test_upsert_partitions_moves_keys_and_empties_partitions(spark, folder, rows):
    path = f"{folder}/t"
    schema = "id int, name string, seg string"
    stored = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s1"), (3, "c", "s2"), (4, "d", "s3")], schema)
    K.write_partitioned(stored, path, "seg")
    untouched = [p.name for p in (Path(path) / "seg=s3").glob("*.parquet")]
    keyed.upsert_partitions(path, spark.createDataFrame([(1, "A", "s2")], schema), ["id"], [F.col("name")], "seg")
    assert rows(spark.read.parquet(path)) == [(1, "A", "s2"), (2, "b", "s1"), (3, "c", "s2"), (4, "d", "s3")]
    assert [p.name for p in (Path(path) / "seg=s3").glob("*.parquet")] == untouched
    keyed.upsert_partitions(path, spark.createDataFrame([(2, "B", "s2")], schema), ["id"], [F.col("name")], "seg")
    assert rows(spark.read.parquet(path)) == [(1, "A", "s2"), (2, "B", "s2"), (3, "c", "s2"), (4, "d", "s3")]


def test_upsert_partitions_with_null_and_spaced_values(spark, folder, rows):
    path = f"{folder}/t"
    schema = "id int, name string, seg string"
    K.write_partitioned(spark.createDataFrame([(1, "a", None), (2, "b", "s 1:x"), (3, "c", "s2")], schema), path, "seg")
    changes = spark.createDataFrame([(1, "A", "s2"), (2, "B", "s2")], schema)
    keyed.upsert_partitions(path, changes, ["id"], [F.col("name")], "seg")
    assert rows(spark.read.parquet(path)) == [(1, "A", "s2"), (2, "B", "s2"), (3, "c", "s2")]
    assert [p.name for p in Path(path).iterdir() if p.is_dir()] == ["seg=s2"]


def test_fingerprint_ignores_order_and_counts_copies(spark):
    rng = random.Random(1)
    raw = [(rng.randint(0, 5), rng.choice(["a", "b\nc=1:x", None, ""])) for _ in range(300)]
    df = posts(spark, *raw)

    def of(frame, table="t", profile="default"):
        return P.table_fingerprint(frame, table, profile).first()

    base = of(df)
    assert base["row_count"] == 300
    assert of(df.orderBy("name", "id").repartition(7)) == base
    assert of(df.select("name", "id")) == base
    assert of(df.union(df.limit(1)))["fingerprint"] != base["fingerprint"]
    assert of(df.union(df))["fingerprint"] != base["fingerprint"]
    assert of(df, profile="large")["fingerprint"] != base["fingerprint"]
    assert of(posts(spark, (1, None)))["fingerprint"] != of(posts(spark, (1, "")))["fingerprint"]
    assert of(df.filter("id > 99"))["row_count"] == 0


def test_canonical_numbers_are_exact(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e300, -1e-300, 5e-324, 1.7976931348623157e308, 2.0**52, 2.0**53 - 1, float("nan"), float("inf"), -float("inf"), None]
    values += [rng.choice((-1, 1)) * rng.random() * 2.0 ** rng.randint(-1070, 1020) for _ in range(500)] + [2.0**k for k in range(-1074, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", P.canonical(F.col("x"), df.schema["x"].dataType).alias("t")).collect():
        if r.x is None or r.x != r.x or r.x in (0, float("inf"), -float("inf")):
            assert r.t == {None: None, "nan": "nan", "0.0": "0", "-0.0": "0", "inf": "inf", "-inf": "-inf"}[r.x if r.x is None else str(r.x)]
        else:
            whole, power = r.t.split("p")
            assert Fraction(int(whole)) * Fraction(2) ** int(power) == Fraction(r.x)
            assert 2**52 <= abs(int(whole)) < 2**53


def test_fingerprints_of_many_doubles_are_compiled(spark, capsys):
    """Java interprets generated methods of more than 8,000 bytes, however many rows there are."""
    table = spark.range(3).select(*[(F.col("id") * 0.1 * i).alias(f"x{i}") for i in range(1, 7)])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        P.part_digests(table).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_fingerprints_of_nested_values(spark):
    def of(value):
        return P.table_fingerprint(spark.sql(f"SELECT {value} AS v"), "t").first()["fingerprint"]

    prints = [
        of(v)
        for v in (
            "array('a,1', 'b')", "array('a', '1:b')", "array('a,1,b')", "array('a', NULL)", "array('a')", "map('a', 1, 'b', 2)", "map('a', 2, 'b', 1)",
            "named_struct('p', 1, 'q', NULL)", "named_struct('p', NULL, 'q', 1)", "array(array(1), array(2))", "array(array(1, 2))",
            "DATE '2024-01-01'", "X'61'", "CAST(1 AS double)", "TIMESTAMP_NTZ '2024-01-01 00:00:00.000001'", "TIMESTAMP_NTZ '2024-01-01 00:00:00'",
        )
    ]
    assert len(set(prints)) == len(prints)
    assert of("map('a', 1, 'b', 2)") == of("map('b', 2, 'a', 1)")


def test_texts_keep_microseconds(spark, folder, rows):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:13.179575' AS a, TIMESTAMP '2024-01-01 00:00:13.000001' AS b")
    for kind in ("json", "csv"):
        path = K.append_files(df, folder, kind, kind)
        back = spark.read.schema(df.schema).option("header", True).format(kind).load(path)
        assert rows(back) == rows(df)


def test_verify(spark):
    left = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, fingerprint string")
    right = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "k string, fingerprint string")
    assert {r.k: r.matches for r in P.verify(left, right, ["k"]).collect()} == {"a": True, "b": False, "c": False}


def sluices(spark, *rows):
    return spark.createDataFrame(list(rows), SLUICES.schema)


def test_refresh_only_on_change(spark, folder, rows):
    path, meta = f"{folder}/sluices", f"{folder}/meta"
    spring = sluices(spark, ("Isar", 4, 12.5, date(1921, 6, 1)), ("Inn", 9, None, None), ("Isar", 4, 12.5, date(1921, 6, 1)), (None, 0, -0.0, None))
    flood = sluices(spark, ("Würm", 2, 3.25, date(2001, 1, 31)))

    def load(df, **kw):
        r = D.refresh(spark, SLUICES, df, path, meta, **kw)
        return r.seeded, r.rows, r.skipped

    assert load(spring) == (1, 4, 0) and load(spring.orderBy("gates").repartition(5)) == (0, 0, 1)
    assert load(spring.dropDuplicates()) == (1, 3, 0)  # a copy less is a change
    assert load(spring.dropDuplicates(), force=True) == (1, 3, 0)
    assert load(flood, profile="flood") == (1, 1, 0) and rows(spark.read.parquet(path)) == rows(flood)
    assert load(flood, profile="flood") == (0, 0, 1)
    assert load(spring.dropDuplicates()) == (1, 3, 0)  # back from the other profile
    assert load(None, profile="dry") == (0, 0, 0) and load(flood.limit(0), profile="dry") == (0, 0, 0)
    assert spark.read.parquet(path).count() == 3
    assert load(None, profile="dry", clean=True) == (1, 0, 0) and spark.read.parquet(path).count() == 0
    assert [r["profile"] for r in spark.read.parquet(meta).filter("loaded").collect()] == ["dry"]


def test_seed_profiles(spark, folder):
    csv, lines = Path(folder) / "many.csv", Path(folder) / "one.json"
    csv.write_text("built,river\n" + "".join(f"19{i:02d}-05-01,river {i}\n" for i in range(37)))
    lines.write_text('[{"river": "Lech", "gates": 11}]')
    seed = D.Seed(
        inline=({"river": "Isar", "gates": 4}, {"width_m": 0.5}), file="is not read",
        profiles={"many": D.Seed(file=str(csv)), "one": D.Seed(file=str(lines)), "none": D.Seed()},
    )
    assert sorted(r.gates or 0 for r in D.seed_rows(spark, SLUICES, seed).collect()) == [0, 4]
    many = D.seed_rows(spark, SLUICES, seed, "many")
    assert many.count() == 37 and many.agg(F.max("built")).first()[0] == date(1936, 5, 1)
    assert D.seed_rows(spark, SLUICES, seed, "one").first().asDict() == {"river": "Lech", "gates": 11, "width_m": None, "built": None}
    assert D.seed_rows(spark, SLUICES, seed, "none") is None
    with pytest.raises(KeyError, match="many, none, one"):
        D.seed_rows(spark, SLUICES, seed, "twice")


@pytest.mark.parametrize("policy,kept,archived", [("delete", [2], []), ("archive", [2], [1]), ("notify", [1, 2], [])])
def test_retention(spark, folder, policy, kept, archived):
    path, archive = f"{folder}/t", f"{folder}/a"
    spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 5))], "id int, at timestamp_ntz").write.parquet(path)
    gone = D.apply_retention(spark.read.parquet(path), path, "at", 10, F.lit("2024-01-12").cast("date"), policy, archive)
    assert [r.id for r in gone.collect()] == [1]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == kept
    assert [r.id for r in spark.read.parquet(archive).collect()] == archived if archived else not K.path_exists(spark, archive)


def test_partition_retention(spark, folder):
    path, archive = f"{folder}/t", f"{folder}/a"
    df = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 11)], "id int, day string")
    K.write_partitioned(df, path, "day")
    assert D.apply_partition_retention(spark, path, "day", 5, date(2024, 1, 10), "notify") == [f"2024-01-0{i}" for i in range(1, 5)]
    D.apply_partition_retention(spark, path, "day", 5, date(2024, 1, 10), "archive", archive)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(5, 11))
    assert sorted(r.id for r in spark.read.parquet(archive).collect()) == [1, 2, 3, 4]


def test_model_tables(spark, folder):
    df = posts(spark, (1, "a"), (2, "b"))
    saved = K.save_model(df, "weirgate_model_test", cluster_by=["id"], buckets=2, path=f"{folder}/m")
    assert saved.count() == 2
    K.recreate_table(df.select("id"), "weirgate_model_test", f"{folder}/m2")
    assert spark.table("weirgate_model_test").columns == ["id"]
    spark.sql("DROP TABLE weirgate_model_test")
