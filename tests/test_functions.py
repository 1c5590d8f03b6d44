import random
import re

import pytest
from pyspark.sql import functions as F

from weirgate.functions import collections as K
from weirgate.functions import identifiers as I
from weirgate.functions import times as S
from weirgate.functions import versions as V


def apply(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_identifiers(spark):
    cases = {
        "a": True, "abc-1": True, "1a": True, "": False, "-a": False, "a-": False, "A": False, "a_b": False,
        "a" * 63: True, "a" * 64: False, "a--b": True, "a\n": False, "é": False,
    }
    assert apply(spark, list(cases), I.is_identifier) == list(cases.values())
    assert apply(spark, [None], I.is_identifier) == [False]


def test_schema_refs(spark):
    cases = {
        "users": True, "users@^1.0.0": True, "users@": False, "@1": False, "Users": False, "u-@1": False,
        "a" * 80: True, "a@b@c": True, "": False,
    }
    assert apply(spark, list(cases), I.is_schema_ref) == list(cases.values())
    refs = ["users@^1.0.0", "users", "a@b@c"]
    assert apply(spark, refs, I.schema_ref_module) == ["users", "users", "a"]
    assert apply(spark, refs, I.schema_ref_constraint) == ["^1.0.0", "", "b@c"]
    back = apply(spark, refs, lambda r: I.format_schema_ref(I.schema_ref_module(r), I.schema_ref_constraint(r)))
    assert back == refs
    assert apply(spark, ["^1.0", ">= 2", "~<=3", "4^"], I.strip_constraint) == ["1.0", "2", "3", "4^"]


def test_digest(spark):
    empty = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert apply(spark, [""], I.sha256_digest) == [empty]


def test_version_and_duration_forms(spark):
    versions = {
        "1.2.3": True, "0.0.0": True, "01.2.3": True, "1.2.3.4": True, "1.2.3-rc.1": True, "1.2.3+b7": True, "1.2.3-": True,
        "1.2.3-a b": True, "10.20.30-x+y": True, "1.2": False, "1": False, "": False, "1.2.": False, ".1.2": False,
        "1..2": False, "v1.2.3": False, "1.2.x": False, "1.2.3a": False, "-1.2.3": False, "1.2-3": False, " 1.2.3": False,
        "1.2.3 ": False, "1.2+3.4": False, "1.2.-3": False,
    }
    assert apply(spark, list(versions), V.is_semver) == list(versions.values())
    durations = {
        "5": True, "90": True, "1h": True, "1h30m": True, "2m5s": True, "7sms": True, "0h0": True, "12hh": True, "": False,
        "h": False, "m5": False, "s": False, "1d": False, "1.5h": False, "-1h": False, "1h 5m": False, "1H": False, "5m?": False,
    }
    assert apply(spark, list(durations), S.is_duration) == list(durations.values())


def test_random_identifiers(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1-A") for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    expected = [bool(re.fullmatch("[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", t)) for t in texts]
    assert apply(spark, texts, I.is_identifier) == expected


def test_version_order_and_ranges(spark):
    versions = ["1.2.0", "1.10.0", "2.0.0-rc1", "2.0.0", "0.3.1", "0.4.0", "1.2.9", "1.3.0"]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    order = [r[0] for r in df.orderBy(V.version_order(F.col("v"))).collect()]
    assert order == ["0.3.1", "0.4.0", "1.2.0", "1.2.9", "1.3.0", "1.10.0", "2.0.0-rc1", "2.0.0"]

    def within(text):
        return sorted(r[0] for r in df.filter(V.satisfies(F.col("v"), text)).collect())

    assert within("^1.2.0") == ["1.10.0", "1.2.0", "1.2.9", "1.3.0"]
    assert within("~1.2") == ["1.2.0", "1.2.9"]
    assert within("^0.3.0") == ["0.3.1"]
    assert within(">=1.3.0 <2.0.0") == ["1.10.0", "1.3.0"]
    assert within("1.2.9") == ["1.2.9"]
    assert len(within("*")) == len(versions)
    assert within("0.3 || ~1.3") == ["0.3.1", "1.3.0"]
    assert within("1.2.x") == within("1.2") == ["1.2.0", "1.2.9"]
    assert within(">1.2") == ["1.10.0", "1.3.0", "2.0.0"]
    assert within("<=1.2") == ["0.3.1", "0.4.0", "1.2.0", "1.2.9"]
    assert within(">=2.0.0-rc1") == ["2.0.0", "2.0.0-rc1"]
    assert within(">2.0.0-rc1") == ["2.0.0"]
    for wrong in ("latest", "1.2.3 ||", ">", "1.x.3"):
        with pytest.raises(ValueError):
            V.satisfies(F.col("v"), wrong)


def test_version_precedence(spark):
    ascending = [
        "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.9",
        "1.0.0-rc.10", "1.0.0+b-1", "1.0.1-99999999999999999999", "1.0.1-a", "1.0.1",
    ]
    df = spark.createDataFrame([(v,) for v in reversed(ascending)], "v string")
    assert [r[0] for r in df.orderBy(V.version_order(F.col("v"))).collect()] == ascending
    assert df.filter(V.satisfies(F.col("v"), ">=1.0.0")).orderBy("v").collect() == [("1.0.0+b-1",), ("1.0.1",)]


def test_times(spark):
    assert apply(spark, ["1h30m", "45s", "2m5s", "90", "h1", "", None, "1s1h"], S.duration_seconds) == [
        5400, 45, 125, None, None, None, None, None,
    ]
    ages = [5, 60, 119, 3600, 7300, 86400, 200000, None]
    assert apply(spark, ages, S.relative_time, "bigint") == [
        "just now", "1 minutes ago", "1 minutes ago", "1 hour ago", "2 hours ago", "1 day ago", "2 days ago", None,
    ]
    assert apply(spark, [59, 60, 3599, 3600, 90000], S.short_duration, "bigint") == ["59s", "1m", "59m", "1h", "25h"]
    parsed = apply(spark, ["2024-01-02T03:04:05Z", "nonsense"], S.parse_iso)
    assert str(parsed[0]) == "2024-01-02 03:04:05" and parsed[1] is None


def test_collections(spark):
    tags = [["a", "b"], ["a"], [], None]
    assert apply(spark, tags, lambda t: K.has_all_tags(t, ["a", "b"]), "array<string>") == [True, False, False, False]
    assert apply(spark, tags, lambda t: K.has_all_tags(t, []), "array<string>") == [True] * 4
    labels = [{"team": "x", "tier": "1"}, {"team": "y"}, {}, None]
    assert apply(spark, labels, lambda c: K.has_all_labels(c, {"team": "x"}), "map<string,string>") == [
        True, False, False, False,
    ]
    levels = ["public", "internal", "confidential", "restricted", "other", None]
    assert apply(spark, levels, K.classification_rank) == [0, 1, 2, 3, None, None]
    df = spark.createDataFrame([("n", c) for c in ("internal", "restricted", None)], "n string, c string")
    assert df.groupBy("n").agg(K.highest_classification(F.col("c"))).first()[1] == "restricted"
