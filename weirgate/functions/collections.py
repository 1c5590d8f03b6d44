"""Labels, tags, JSON text and ordered classifications."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classification levels from least to most sensitive.
CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")


def has_all_tags(tags: Column, wanted: Iterable[str]) -> Column:
    """True when the tag array holds every wanted tag; true for no wanted tags."""
    needed = [F.lit(t) for t in wanted]
    if not needed:
        return F.lit(True)
    return F.coalesce(F.forall(F.array(*needed), lambda t: F.array_contains(tags, t)), F.lit(False))


def has_all_labels(labels: Column, wanted: Mapping[str, str]) -> Column:
    """True when the label map holds every wanted key with its value."""
    condition = F.lit(True)
    for key, value in wanted.items():
        condition = condition & F.coalesce(F.try_element_at(labels, F.lit(key)) == F.lit(value), F.lit(False))
    return condition


def joined(values: Column, separator: str = ",") -> Column:
    """Array as sorted, separated text."""
    return F.array_join(F.sort_array(values), separator)


def json_or_empty(value: Column) -> Column:
    """JSON text of a struct or map; ``{}`` when absent."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def classification_rank(classification: Column) -> Column:
    """0 for public up to 3 for restricted; NULL for anything else."""
    position = F.array_position(F.array(*[F.lit(c) for c in CLASSIFICATIONS]), classification)
    return F.when(position > 0, (position - 1).cast("int"))


def classification_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in CLASSIFICATIONS]), (rank + 1).cast("int"))


def highest_classification(classification: Column) -> Column:
    """Aggregate: the most sensitive level in the group."""
    return classification_name(F.max(classification_rank(classification)))
