"""Semantic versions: check, order, and range conditions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: three or more dotted numbers, then an optional pre-release or build part.
SEMVER = r"(?s)^[0-9]+(\.[0-9]+){2,}([-+].*)?\z"
_PART = r"(?:\d+|[xX*])"
_COMPARATOR = re.compile(rf"(\^|~|>=|<=|>|<|=)?\s*v?({_PART}(?:\.{_PART}){{0,2}})(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?(?=[\s,]|$)")


def is_semver(version: Column) -> Column:
    return F.coalesce(version.rlike(SEMVER), F.lit(False))


def version_numbers(version: Column) -> Column:
    """The dotted numbers as ``array<bigint>``, which orders numerically (2.0.0 before 10.0.0)."""
    core = F.regexp_extract(version, r"^[0-9.]+", 0)
    return F.split(core, r"\.").cast("array<bigint>")


def _pre_release(version: Column) -> Column:
    """Text between the first ``-`` and the build part; empty for a release."""
    return F.regexp_extract(version, r"^[0-9.]+-([^+]*)", 1)


def _identifiers(pre: Column) -> Column:
    """Dot-separated identifiers in their order: numbers by value below words, words by their bytes."""

    def ranked(part: Column) -> Column:
        number = part.rlike(r"^[0-9]+\z")
        digits = F.ltrim(part, F.lit("0"))
        return F.struct(
            (~number).cast("int").alias("word"), F.when(number, F.length(digits)).otherwise(0).alias("length"),
            F.when(number, digits).otherwise(part).alias("text"),
        )

    return F.transform(F.split(pre, r"\."), ranked)


def _precedence(version: Column) -> Column:
    pre = _pre_release(version)
    release = F.coalesce((pre == "").cast("int"), F.lit(0))
    return F.struct(version_numbers(version).alias("numbers"), release.alias("release"), _identifiers(pre).alias("pre"))


def version_order(version: Column) -> Column:
    """Sort key: numbers, then pre-releases identifier by identifier below their release; equal ones by text."""
    return F.struct(_precedence(version).alias("precedence"), version.alias("text"))


def satisfies(version: Column, constraint: str) -> Column:
    """Condition for a range such as ``^1.2.0``, ``~1.2``, ``>=1.0.0 <2.0.0``, ``1.2.x`` or ``1.2 || ^2.0.0``.

    Parts left out (or ``x``, ``*``) stand for any value: ``1.2`` is 1.2.x, ``>1.2`` starts at 1.3.0. Pre-releases
    only meet an alternative that names one. The constraint is a driver-side argument, so the result is an ordinary
    comparison.
    """
    if constraint.strip() in ("", "*"):
        return is_semver(version)
    return is_semver(version) & reduce(or_, [_alternative(version, a.strip(), constraint) for a in constraint.split("||")])


def _alternative(version: Column, text: str, whole: str) -> Column:
    terms = list(_COMPARATOR.finditer(text))
    if not terms or _COMPARATOR.sub("", text).strip(" ,"):
        raise ValueError(f"unsupported version constraint: {whole!r}")
    tests = []
    for op, numbers, pre, _ in (t.groups() for t in terms):
        given = [None if p in "xX*" else int(p) for p in numbers.split(".")]
        known = given[: given.index(None)] if None in given else given
        if any(p is not None for p in given[len(known):]) or (pre and len(known) < 3):
            raise ValueError(f"unsupported version constraint: {whole!r}")
        tests += _bounds(_precedence(version), op or "=", known, (pre or "")[1:])
    if not any(t.group(3) for t in terms):
        tests.append(_pre_release(version) == "")
    return reduce(and_, tests, F.lit(True))


def _at(parts: list[int], pre: str = "") -> Column:
    return _precedence(F.lit(".".join(map(str, parts + [0] * (3 - len(parts)))) + (f"-{pre}" if pre else "")))


def _bounds(version: Column, op: str, given: list[int], pre: str) -> list[Column]:
    """Comparisons that a term stands for; the upper end of a wildcard is open and leaves its pre-releases out."""

    def after(i: int) -> Column:
        return _at([*given[:i], given[i] + 1], "0")

    if not given:
        return [F.lit(False)] if op in "<>" else []
    start, last = _at(given, pre), len(given) - 1
    if op == ">=":
        return [version >= start]
    if op == "<":
        return [version < start]
    if op == ">":
        return [version > start if last == 2 else version >= after(last)]
    if op == "<=":
        return [version <= start if last == 2 else version < after(last)]
    if op == "=" and last == 2:
        return [version == start]
    if op == "^":
        last = next((i for i, p in enumerate(given) if p > 0), last)
    elif op == "~":
        last = min(last, 1)
    return [version >= start, version < after(last)]
