"""The balanced windows against a plain computation, with one key holding most rows."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirgate.operators.windows import SPAN, newest, previous_instant, previous_value, running_total, spans

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        at = START + timedelta(minutes=rng.randint(0, 4000) if key != "b" else 5)
        rows.append((i, key, at, rng.randint(-3, 5)))
    return rows, spark.createDataFrame(rows, "id int, k string, at timestamp_ntz, n int").repartition(6).cache()


def by_key(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    return groups


def test_running_total(data, rows):
    raw, df = data
    expected = []
    for key, group in by_key(raw).items():
        total, sums = 0, Counter()
        for r in group:
            sums[r[2]] += r[3]
        for at in sorted(sums):
            total += sums[at]
            expected.append((key, at, sums[at], total))
    assert rows(running_total(df, ["k"], "at", "n", "upto")) == sorted(expected, key=repr)


def test_running_total_without_keys(data):
    raw, df = data
    result = running_total(df, [], "at", "n", "upto").orderBy(F.col("at").desc()).first()
    assert result["upto"] == sum(r[3] for r in raw)


def test_previous_instant(data, rows):
    raw, df = data
    expected = []
    for key, group in by_key(raw).items():
        instants = sorted({r[2] for r in group})
        expected += [(key, at, before) for before, at in zip([None, *instants], instants)]
    assert rows(previous_instant(df, ["k"], "at", "before")) == sorted(expected, key=repr)


def test_previous_value(data, rows):
    raw, df = data
    expected = []
    for key, group in by_key(raw).items():
        ordered = sorted(group, key=lambda r: (r[2], r[0]))
        expected += [(*r, before) for before, r in zip([None, *[r[3] for r in ordered]], ordered)]
    got = previous_value(df, ["k"], "at", "id", "n", "before").select("id", "k", "at", "n", "before")
    assert rows(got) == sorted(expected, key=repr)


@pytest.mark.parametrize("n", [1, 3, 2000])
def test_newest(data, rows, n):
    raw, df = data
    expected = []
    for group in by_key(raw).values():
        ordered = sorted(group, key=lambda r: (-r[2].timestamp(), r[0]))[:n]
        expected += [(*r, i + 1) for i, r in enumerate(ordered)]
    got = newest(df, ["k"], [F.col("at").desc(), F.col("id")], n, rank="rank")
    assert rows(got) == sorted(expected, key=repr)


def test_newest_drops_rows_before_the_shuffle(data):
    _, df = data
    plan = newest(df, ["k"], [F.col("at").desc(), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan


def test_running_total_needs_no_join(data):
    _, df = data
    plan = running_total(df, ["k"], "at", "n", "upto")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


DENSE = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def dense(spark):
    """40,000 rows, two thirds of them in one second of one key, and 9,000 of those in one instant."""
    before = {k: spark.conf.get(k, None) for k in DENSE}
    for key, value in DENSE.items():
        spark.conf.set(key, value)
    yield spark.range(40_000).selectExpr(
        "id",
        "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 50) END AS k",
        """CASE WHEN id % 3 > 0 THEN timestampadd(MICROSECOND, CAST(greatest(id - 13500, 0) AS int), TIMESTAMP_NTZ '2024-01-01 10:00:00')
                ELSE timestampadd(MINUTE, CAST(id AS int), TIMESTAMP_NTZ '2023-01-01 00:00:00') END AS at""",
        "CAST(id % 7 AS int) AS n",
    ).cache()
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_dense_second_of_one_key_is_many_spans(dense):
    sizes = [r["count"] for r in spans(dense, ["k"], ["at", "id"]).groupBy(SPAN).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * 40_000 / 16
    instants = dense.select("k", "at").distinct()
    sizes = [r["count"] for r in spans(instants, ["k"], ["at"]).groupBy(SPAN).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * instants.count() / 16


def test_dense_keys_against_plain_windows(dense):
    by_time = W.partitionBy("k").orderBy("at", "id")
    plain = dense.withColumn("before", F.lag("n").over(by_time))
    assert previous_value(dense, ["k"], "at", "id", "n", "before").exceptAll(plain).isEmpty()
    sums = dense.groupBy("k", "at").agg(F.sum("n").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("at")))
    assert running_total(dense, ["k"], "at", "n", "upto").exceptAll(upto).isEmpty()
    steps = sums.select("k", "at", F.lag("at").over(W.partitionBy("k").orderBy("at")).alias("before"))
    assert previous_instant(dense, ["k"], "at", "before").exceptAll(steps).isEmpty()


def test_newest_rejects_zero(data):
    with pytest.raises(ValueError):
        newest(data[1], ["k"], [F.col("id")], 0)
