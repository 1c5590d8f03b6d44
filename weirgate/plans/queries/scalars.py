"""Scalar functions over table columns."""

from pyspark.sql import functions as F

from weirgate.functions import collections as K
from weirgate.functions import identifiers as I
from weirgate.functions import times as S
from weirgate.functions import versions as V
from weirgate.operators.windows import newest
from weirgate.plans.registry import query


@query(
    "X1 X2 X3",
    """SELECT dataset, concat_ws('/', 'data', dataset) AS record_id, string_split(schema_ref, '@')[1] AS module,
              CASE WHEN contains(schema_ref, '@') THEN string_split(schema_ref, '@')[2] ELSE '' END AS constraint_text,
              schema_ref AS formatted,
              CASE WHEN contains(schema_ref, '@') THEN regexp_replace(string_split(schema_ref, '@')[2], '^[~^>=< ]+', '') ELSE '' END AS bare
       FROM schema_refs WHERE schema_ref IS NOT NULL""",
)
def schema_references(t):
    ref = F.col("schema_ref")
    module, constraint = I.schema_ref_module(ref), I.schema_ref_constraint(ref)
    return t.schema_refs.filter(ref.isNotNull()).select(
        "dataset",
        I.record_id(F.lit("data"), F.col("dataset")).alias("record_id"),
        module.alias("module"),
        constraint.alias("constraint_text"),
        I.format_schema_ref(module, constraint).alias("formatted"),
        I.strip_constraint(constraint).alias("bare"),
    )


@query(
    "X4 X5",
    """SELECT p_partkey, regexp_full_match(p_name, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?') AS name_ok,
              regexp_full_match(replace(p_name, ' ', '-'), '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?') AS slug_ok,
              regexp_full_match(replace(lower(p_brand), '#', '@'), '[a-z0-9]([a-z0-9-]*[a-z0-9])?(@.+)?') AS ref_ok,
              regexp_full_match(concat(lower(p_type), '@'), '[a-z0-9]([a-z0-9-]*[a-z0-9])?(@.+)?') AS open_ref_ok
       FROM part""",
)
def identifier_checks(t):
    return t.part.select(
        "p_partkey",
        I.is_identifier(F.col("p_name")).alias("name_ok"),
        I.is_identifier(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug_ok"),
        I.is_schema_ref(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("@"))).alias("ref_ok"),
        I.is_schema_ref(F.concat(F.lower("p_type"), F.lit("@"))).alias("open_ref_ok"),
    )


@query(
    "X6",
    """SELECT name, version, regexp_full_match(version, '[0-9]+([.][0-9]+){2,}([-+].*)?') AS is_version,
              regexp_full_match(substr(version, 3), '[0-9]+([.][0-9]+){2,}([-+].*)?') AS tail_is_version,
              CAST(row_number() OVER (PARTITION BY namespace ORDER BY list_transform(string_split(version, '.'), lambda x: CAST(x AS BIGINT)) DESC, record_id) = 1 AS BOOLEAN) AS highest
       FROM catalog""",
)
def version_order(t):
    records = t.catalog
    top = newest(records, ["namespace"], [V.version_order(F.col("version")).desc(), F.col("record_id")]).select(
        "record_id", F.lit(True).alias("highest")
    )
    return records.join(top, "record_id", "left").select(
        "name",
        "version",
        V.is_semver(F.col("version")).alias("is_version"),
        V.is_semver(F.substr(F.col("version"), F.lit(3))).alias("tail_is_version"),
        F.coalesce("highest", F.lit(False)).alias("highest"),
    )


@query(
    "X7",
    """SELECT event_id, dur, regexp_full_match(dur, '[0-9][0-9hms]*') AS is_duration,
              CASE WHEN regexp_full_match(dur, '([0-9]+h)?([0-9]+m)?([0-9]+s)?') AND dur <> '' THEN
                coalesce(TRY_CAST(regexp_extract(dur, '([0-9]+)h', 1) AS BIGINT), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(dur, '([0-9]+)m', 1) AS BIGINT), 0) * 60
                + coalesce(TRY_CAST(regexp_extract(dur, '([0-9]+)s', 1) AS BIGINT), 0) END AS seconds
       FROM (SELECT event_id, CASE event_type WHEN 'view' THEN concat(user_id, 'h', event_id % 60, 'm') WHEN 'click' THEN concat(event_id, 's')
                                              WHEN 'error' THEN 'h5' WHEN 'signup' THEN CAST(user_id AS VARCHAR) ELSE concat('1h', user_id, 's') END AS dur FROM events)""",
)
def duration_texts(t):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    text = (
        F.when(F.col("event_type") == "view", F.concat(user, F.lit("h"), (F.col("event_id") % 60).cast("string"), F.lit("m")))
        .when(F.col("event_type") == "click", F.concat(event, F.lit("s")))
        .when(F.col("event_type") == "error", "h5")
        .when(F.col("event_type") == "signup", user)
        .otherwise(F.concat(F.lit("1h"), user, F.lit("s")))
    )
    return t.events.select("event_id", text.alias("dur")).select(
        "event_id", "dur", S.is_duration(F.col("dur")).alias("is_duration"), S.duration_seconds(F.col("dur")).alias("seconds")
    )


@query(
    "X8",
    """SELECT event_id, CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN concat(age // 60, ' minutes ago')
                   WHEN age < 86400 THEN CASE WHEN age // 3600 = 1 THEN '1 hour ago' ELSE concat(age // 3600, ' hours ago') END
                   ELSE CASE WHEN age // 86400 = 1 THEN '1 day ago' ELSE concat(age // 86400, ' days ago') END END AS age_text,
              CASE WHEN took < 60 THEN concat(took, 's') WHEN took < 3600 THEN concat(took // 60, 'm') ELSE concat(took // 3600, 'h') END AS took_text
       FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS age,
                    CAST(floor(value * 100) AS BIGINT) AS took FROM events)""",
)
def time_texts(t):
    age = S.seconds_between(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    took = F.floor(F.col("value") * 100)
    return t.events.select(
        "event_id", S.relative_time(age).alias("age_text"), S.short_duration(took).alias("took_text")
    )


@query(
    "X9 X10",
    """SELECT id, CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / CAST(1000 AS DOUBLE)) AS BIGINT) AS elapsed_ms,
              strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') AS started, date_trunc('second', start_time) AS parsed FROM runs""",
)
def time_formats(t):
    started = S.iso_text(F.col("start_time"))
    return t.runs.select(
        "id",
        S.millis_between(F.col("start_time"), F.col("end_time")).alias("elapsed_ms"),
        started.alias("started"),
        S.parse_iso(started).alias("parsed"),
    )


@query(
    "X11",
    """SELECT event_id, 'k' AS keys, regexp_extract(props, '([0-9]+)', 1) AS k_text,
              concat('{"user":', user_id, ',"type":"', event_type, '"}') AS packed FROM events""",
)
def json_values(t):
    return t.events.select(
        "event_id",
        K.joined(F.json_object_keys("props")).alias("keys"),
        F.get_json_object("props", "$.k").alias("k_text"),
        K.json_or_empty(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("packed"),
    )


@query(
    "X12 X13",
    """SELECT namespace, name, array_to_string(list_sort(tags), '|') AS tag_text, list_contains(tags, 'gdpr') AND list_contains(tags, 'tier-1') AS tagged,
              string_split(tags[1], '-')[2] = '2' AS labelled,
              CAST(CASE classification WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 END AS INTEGER) AS sensitivity
       FROM catalog""",
)
def tags_and_labels(t):
    tier = F.element_at(F.split(F.element_at("tags", 1), "-"), 2)
    return t.catalog.select(
        "namespace",
        "name",
        K.joined(F.col("tags"), "|").alias("tag_text"),
        K.has_all_tags(F.col("tags"), ["gdpr", "tier-1"]).alias("tagged"),
        K.has_all_labels(F.create_map(F.lit("tier"), tier), {"tier": "2"}).alias("labelled"),
        K.classification_rank(F.col("classification")).alias("sensitivity"),
    )


@query(
    "X13",
    """SELECT namespace, ['public', 'internal', 'confidential', 'restricted'][1 + max(
              CASE classification WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 END)] AS highest
       FROM catalog GROUP BY namespace""",
)
def highest_classification(t):
    return t.catalog.groupBy("namespace").agg(K.highest_classification(F.col("classification")).alias("highest"))


@query("X14", "SELECT doc_id, concat('sha256:', sha256(text)) AS digest FROM documents")
def content_digests(t):
    return t.documents.select("doc_id", I.sha256_digest(F.col("text")).alias("digest"))
