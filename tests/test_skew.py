"""Plans when one key holds a third of the rows or more."""

import pytest
from pyspark.sql import functions as F

from weirgate.operators.events import daily_rollup, enrich_events
from weirgate.sources.keyed import upsert

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def tight(spark):
    """Sizes scaled down, so that the small tables here count as large."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def events(tight):
    ids = tight.range(60_000).repartition(8)
    user = F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5000)
    return ids.select(
        F.col("id").alias("event_id"), user.cast("bigint").alias("user_id"), F.lit("view").alias("event_type"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"),
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_enrichment_splits_the_hot_user(tight, events):
    users = tight.range(5000).select(
        F.col("id").alias("user_id"), F.concat(F.lit("u"), "id").alias("user_name"), F.lit("x").alias("user_email")
    )
    joined = enrich_events(events, users)
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 60_000 and joined.filter("user_name IS NULL").count() == 0


def test_upsert_splits_the_hot_key(tight, events):
    changes = events.filter("event_id < 3000").select("user_id", "payload", "event_id")
    result = upsert(events.select("user_id", "payload"), changes, ["user_id"], [F.col("event_id").desc()])
    plan = final_plan(result)
    assert "skew=true" in plan
    untouched = events.select("user_id").join(changes.select("user_id").distinct(), "user_id", "left_anti").count()
    assert result.count() == untouched + changes.select("user_id").distinct().count()


def test_distinct_users_are_counted_on_their_own_key(tight, events):
    plan = daily_rollup(events)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan.split("hashpartitioning")[-1]
