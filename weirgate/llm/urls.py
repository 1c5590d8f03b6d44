"""URL filters as a temporal join: each capture against the list entries active when it was fetched.

Dated list changes (add or remove a pattern) become validity intervals: changes at one instant are reduced to
one, repeated states are dropped, and an added pattern holds until its next removal. A capture looks up its own
patterns (its host and every parent domain, its host with every path prefix) by equality, together with a time
bucket, and an interval takes part in each bucket that it touches; so the as-of condition is checked within one
pattern and bucket only, and a pattern that holds a third of all captures is spread over time. The join has
plain tables on both sides, which AQE can split further. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.common import stored

BUCKET_SECONDS = 7 * 86_400
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port or a last dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, SCHEME + r"(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + r"[^/?#]*(/[^?#]*)", 1)


def lookup_patterns(url: Column) -> Column:
    """Every pattern a URL can match: ``example.com`` for it and its parents, ``host/a`` and ``host/a/b`` by path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    m = F.size(parts)
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>")))))


def validity(changes: DataFrame) -> DataFrame:
    """Intervals ``(list, pattern, since, until)`` in which a pattern is on a list, from changes
    ``(list, pattern, added, at)`` with ``at`` in seconds; ``until`` is null for the last.

    Add wins over remove at one instant. Changes with a null in any column are left out.
    """
    at_once = changes.where("list is not null and pattern is not null and added is not null and at is not null").groupBy("list", "pattern", "at").agg(F.max("added").alias("added"))
    by_time = Window.partitionBy("list", "pattern").orderBy("at")
    flips = at_once.withColumn("before", F.lag("added", 1, False).over(by_time)).where("added <> before")
    ends = flips.withColumn("until", F.lead("at").over(by_time))
    return ends.where("added").select("list", "pattern", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, changes: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at", bucket: int = BUCKET_SECONDS) -> DataFrame:
    """A row for each different ``(key, url, fetched)``: these, ``n_block``, ``n_allow``, ``pattern`` and ``verdict``.

    ``changes`` has ``list`` ("block" or "allow"), ``pattern``, ``added`` and ``at``; times are whole seconds. The
    longest active pattern decides, "allow" before "block" where both have it; without one the verdict is
    "clear". A URL that is null or has no host, and a capture without a time, match nothing.
    """
    rows = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(fetched).cast("long").alias("fetched")).distinct()
    rows = stored(rows, "captures")
    spans = stored(validity(changes.where(F.col("list").isin("block", "allow"))), "spans")
    last = rows.agg(F.max("fetched").alias("last")).first()["last"]
    cell = lambda c: F.floor(c / F.lit(bucket))
    newest = F.lit(last).cast("long")
    active = (
        spans.where(F.col("since") <= newest)
        .withColumn("cell", F.explode(F.sequence(cell(F.col("since")), cell(F.least(F.coalesce(F.col("until") - 1, newest), newest)))))
        .select("list", "pattern", "since", "until", "cell")
    )
    asked = rows.where("fetched is not null").select("key", "url", "fetched", F.explode(lookup_patterns(F.col("url"))).alias("asked"), cell(F.col("fetched")).alias("at_cell"))
    span = stored(active, "active")
    hits = asked.join(
        span,
        (F.col("asked") == F.col("pattern")) & (F.col("at_cell") == F.col("cell")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))),
    )
    judged = hits.groupBy("key", "url", "fetched").agg(
        F.count_if(F.col("list") == "block").alias("n_block"),
        F.count_if(F.col("list") == "allow").alias("n_allow"),
        F.max(F.struct(F.length("pattern").alias("size"), (F.col("list") == "allow").alias("allow"), F.col("pattern"))).alias("best"),
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"j.{c}")) for c in ("key", "url", "fetched")]
    joined = rows.alias("r").join(stored(judged, "judged").alias("j"), same[0] & same[1] & same[2], "left")
    verdict = F.when(F.col("best").isNull(), "clear").when(F.col("best.allow"), "allowed").otherwise("blocked")
    return joined.select(
        F.col("r.key").alias(key),
        F.col("r.url").alias(url),
        F.col("r.fetched").alias(fetched),
        F.coalesce("n_block", F.lit(0)).alias("n_block"),
        F.coalesce("n_allow", F.lit(0)).alias("n_allow"),
        F.col("best.pattern").alias("pattern"),
        verdict.alias("verdict"),
    )
