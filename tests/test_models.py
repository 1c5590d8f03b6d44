from pathlib import Path

import pytest

from weirgate.contracts import Contract
from weirgate.operators import adoption as D
from weirgate.operators import catalog as C
from weirgate.operators import events as E
from weirgate.operators.quality import column_profile, file_profile, model_tests
from weirgate.plans.models import run_model, run_stages
from pyspark.sql import functions as F


def test_model_sources_and_refs(spark, rows):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, n int")
    text = "{{ config(materialized='table',\n tags=['daily']) }} select x.name, count(*) as c from {{ source('raw', 'my_table') }} x join {{ ref('other') }} y on x.name = y.name group by x.name"
    assert rows(run_model(spark, text, {"raw.my_table": t, "other": t.filter("n = 1")})) == [("a", 2)]
    with pytest.raises(KeyError):
        run_model(spark, "select * from {{ source('raw', 'gone') }}", {})


def test_nothing_is_written_after_a_failure(spark):
    saved = []

    def broken(tables):
        raise RuntimeError("stage failed")

    stages = [lambda t: {"a": t["raw"]}, broken, lambda t: {"b": t["a"]}]
    with pytest.raises(RuntimeError):
        run_stages({"raw": spark.range(3)}, stages, save=lambda name, df: saved.append(name))
    assert saved == ["a"]


def test_stage_outputs_follow_their_contract(spark):
    contract = Contract.from_dict({"name": "a", "schema": [{"name": "id", "type": "string"}, {"name": "extra"}]})
    out = run_stages({"raw": spark.range(2)}, [lambda t: {"a": t["raw"]}], {"a": contract})
    assert out["a"].dtypes == [("id", "string"), ("extra", "string")]


def test_column_tests(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, None), (None, "x")], "id int, name string")
    got = {(r.column_name, r.test): r.violations for r in model_tests(df, {"id": ["unique", "not_null"], "name": ["not_null"]}).collect()}
    assert got == {("id", "unique"): 1, ("id", "not_null"): 1, ("name", "not_null"): 2}
    with pytest.raises(ValueError):
        model_tests(df, {"id": ["positive"]})


def test_unique_tests_share_one_shuffle_of_one_scan(spark, folder):
    path = f"{folder}/t"
    spark.range(100).selectExpr("id", "id % 40 AS twice", "CAST(id % 2 AS double) AS half", "IF(id < 3, NULL, id) AS gaps", "CAST(NULL AS string) AS none").write.parquet(path)
    df = spark.read.parquet(path)
    found = model_tests(df, {c: ["unique"] for c in df.columns})
    assert {r.column_name: r.violations for r in found.collect()} == {"id": 0, "twice": 40, "half": 2, "gaps": 0, "none": 0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan parquet") == 1


def test_column_profile_of_every_kind(spark):
    df = spark.range(1000).selectExpr(
        "IF(id % 4 = 0, NULL, id) AS n", "CAST(id % 10 AS double) / 4 AS x", "date_add(DATE '2024-01-01', CAST(id AS int)) AS day",
        "array(id, NULL) AS list", "map('k', id % 5) AS kv", "named_struct('a', id, 'b', 'é') AS s", "CAST(NULL AS string) AS none", "X'00ff' AS raw",
        "IF(id = 0, double('NaN'), 1.5) AS odd",
    )
    found = {r.column_name: r for r in column_profile(df).collect()}
    assert [found["n"].nulls, found["n"].null_rate, found["none"].null_rate] == [250, 0.25, 1.0]
    assert (found["n"].least, found["n"].greatest) == ("1", "999") and abs(found["n"].approx_median - 500) < 25
    assert abs(found["n"].approx_distinct - 750) < 40 and found["x"].approx_distinct == 10 and found["kv"].approx_distinct == 5
    assert found["none"].approx_distinct == 0 and found["none"].approx_median is None and found["none"].bytes == 0
    assert found["odd"].approx_median == 1.5 and found["odd"].approx_distinct == 2
    assert found["raw"].bytes == 4000 and found["list"].least is None
    empty = column_profile(df.limit(0)).first()
    assert (empty.row_count, empty.null_rate, empty.bytes) == (0, None, 0)


def test_file_profile(spark, folder):
    spark.range(10).repartition(3).write.parquet(f"{folder}/t")
    files = [p for p in Path(folder, "t").glob("*.parquet")]
    assert tuple(file_profile(spark, f"{folder}/t").first())[0] >= len(files) == 3


def test_backfill_range(spark):
    df = spark.sql("select timestamp_ntz'2024-01-31 23:59:59' as ts union all select timestamp_ntz'2024-02-01 00:00:00'")
    assert E.date_range(df, "ts", "2024-01-01", "2024-01-31").count() == 1
    with pytest.raises(ValueError):
        E.date_range(df, "ts", "2024-01-31", "2024-01-31")


def test_signals_hidden_by_escapes_are_found(spark, rows):
    texts = ['{"DATABASE_URL": "x"}', '{"A": "jdbc:postgresql://h"}', '{"PG\\u0048OST": "h"}', '{"LOG": "info"}', "nonsense", None]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "resource_name string, js string")
    df = df.withColumn("cluster", F.lit("c")).withColumn("namespace", F.lit("n"))
    found = D.indicators_from_json(df, "js", F.lit("env")).select("release_name", "indicator_key")
    assert rows(found) == [("r0", "DATABASE_URL"), ("r1", "A"), ("r2", "PGHOST")]
    flags = df.select(D.has_signal(F.col("js"))).collect()
    assert [r[0] for r in flags] == [True, True, True, False, False, False]


def test_assessment(spark):
    releases = spark.createDataFrame([("c", "n", r, "chart") for r in ("both", "claim", "signal", "none")], "cluster string, namespace string, release_name string, chart_name string")
    claims = spark.createDataFrame([("c", "n", r, t) for r, t in (("both", "postgres"), ("claim", "mysql"), ("claim", "postgres"))], "cluster string, namespace string, claim_name string, db_type string")
    signals = spark.createDataFrame([("c", "n", r, k, "PGHOST") for r, k in (("both", "env"), ("signal", "secret"), ("signal", "env"))], "cluster string, namespace string, release_name string, indicator_type string, indicator_key string")
    report = D.adoption_report(releases, claims, signals)
    got = {r.release_name: (r.assessment, r.indicator_types, r.db_type) for r in report.collect()}
    assert got == {
        "both": ("managed", "env", "postgres"), "claim": ("managed", "", "mysql"),
        "signal": ("unmanaged", "env,secret", None), "none": ("no-db", "", None),
    }
    levels = {(r.level, r.cluster, r.namespace): r.releases for r in D.posture(report).collect()}
    assert levels == {(0, "c", "n"): 4, (1, "c", None): 4, (3, None, None): 4}


def test_search_minds_the_case(spark, rows):
    df = spark.createDataFrame([("n", "Orders", None, ["a"]), ("n", "x", "about Orders", ["a", "b"])], "namespace string, name string, description string, tags array<string>")
    assert C.search(df, text="orders").count() == 0 and C.search(df, text="orders", ignore_case=True).count() == 2
    assert [r.name for r in C.search(df, text="Orders", tags=["a", "b"]).collect()] == ["x"]
    assert C.search(df, name="nonexistent").count() == 0


def test_best_version_by_labels(spark):
    rows = [("d", "1.9.0", {"team": "x"}, "1"), ("d", "1.10.0", {"team": "x"}, "2"), ("d", "2.0.0", {"team": "x"}, "3"), ("e", "1.0.0", {"team": "y"}, "4")]
    df = spark.createDataFrame(rows, "name string, version string, labels map<string,string>, record_id string")
    assert [(r.name, r.version) for r in C.resolve(df, {"team": "x"}, "^1.0.0").collect()] == [("d", "1.10.0")]
