"""Durations, relative times and ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a digit, then digits and the unit letters h, m, s.
DURATION = r"^[0-9][0-9hms]*\z"
UNIT_SECONDS = {"h": 3600, "m": 60, "s": 1}


def is_duration(text: Column) -> Column:
    return F.coalesce(text.rlike(DURATION), F.lit(False))


def duration_seconds(text: Column) -> Column:
    """Seconds in a duration such as ``1h30m``; NULL when the text is not one or has no unit."""
    parsed = F.lit(0).cast("bigint")
    for unit, seconds in UNIT_SECONDS.items():
        amount = F.regexp_extract(text, rf"([0-9]+){unit}", 1)
        parsed = parsed + F.when(amount == "", F.lit(0)).otherwise(amount.try_cast("bigint")) * F.lit(seconds)
    return F.when(text.rlike(r"^([0-9]+h)?([0-9]+m)?([0-9]+s)?\z") & (text != ""), parsed)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end."""
    return F.floor((micros(end) - micros(start)) / F.lit(1000)).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded down."""
    return F.floor((micros(end) - micros(start)) / F.lit(1_000_000)).cast("bigint")


def short_duration(seconds: Column) -> Column:
    """``42s``, ``7m`` or ``3h``: the largest whole unit."""
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds.isNotNull(), F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
    )


def relative_time(seconds_ago: Column) -> Column:
    """Age in words. Minutes have no singular form; hours and days do."""
    hours = F.floor(seconds_ago / 3600)
    days = F.floor(seconds_ago / 86400)

    def counted(n: Column, word: str) -> Column:
        return F.when(n == 1, F.lit(f"1 {word} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {word}s ago")))

    return (
        F.when(seconds_ago < 60, F.lit("just now"))
        .when(seconds_ago < 3600, F.concat(F.floor(seconds_ago / 60).cast("string"), F.lit(" minutes ago")))
        .when(seconds_ago < 86400, counted(hours, "hour"))
        .when(seconds_ago.isNotNull(), counted(days, "day"))
    )


def iso_text(ts: Column) -> Column:
    """RFC 3339 text in UTC, whole seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Timestamp without zone from RFC 3339 UTC text; NULL when malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")
