"""Catalog search, references, locks and listings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.contracts import Contract
from weirgate.functions.collections import has_all_labels, has_all_tags
from weirgate.functions.identifiers import record_id, schema_ref_module
from weirgate.functions.versions import satisfies, version_order
from weirgate.operators.windows import newest


def _contains(column: Column, text: str, ignore_case: bool) -> Column:
    hit = F.lower(column).contains(text.lower()) if ignore_case else column.contains(text)
    return F.coalesce(hit, F.lit(False))


def search(
    records: DataFrame,
    text: str | None = None,
    namespace: str | None = None,
    kind: str | None = None,
    classification: str | None = None,
    owner: str | None = None,
    tags: Iterable[str] = (),
    name: str | None = None,
    limit: int | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """Records that meet every given term.

    Equality on namespace, type, classification, owner and name; ``text`` must occur in the name or the
    description; all ``tags`` must be present. Text matching minds the case unless told otherwise. With a
    limit, the first ones by namespace and name. No match is an empty result.
    """
    terms = {"namespace": namespace, "type": kind, "classification": classification, "owner": owner, "name": name}
    for column, value in terms.items():
        if value:
            records = records.filter(F.col(column) == value)
    if text:
        records = records.filter(
            _contains(F.col("name"), text, ignore_case) | _contains(F.col("description"), text, ignore_case)
        )
    tags = list(tags)
    if tags:
        records = records.filter(has_all_tags(F.col("tags"), tags))
    if limit is not None:
        records = records.orderBy("namespace", "name").limit(limit)
    return records


def resolve(records: DataFrame, labels: Mapping[str, str] | Iterable[str], constraint: str = "*") -> DataFrame:
    """Best version in range of every dataset carrying all the labels (a map) or tags (a list)."""
    if isinstance(labels, Mapping):
        matching = records.filter(has_all_labels(F.col("labels"), labels))
    else:
        matching = records.filter(has_all_tags(F.col("tags"), labels))
    in_range = matching.filter(satisfies(F.col("version"), constraint))
    return newest(in_range, ("name",), [version_order(F.col("version")).desc(), F.col("record_id")])


def dangling(references: DataFrame, known: DataFrame) -> DataFrame:
    """References (dataset, kind, target) whose target is not among the known (kind, id).

    Nothing is done to the known side before the join, so AQE can split a target with very many references.
    """
    return references.join(known.select("kind", F.col("id").alias("target")), ["kind", "target"], "left_anti")


def unlocked(refs: DataFrame, lock: DataFrame) -> DataFrame:
    """Datasets whose schema reference names a module without a lock entry."""
    wanted = refs.filter(F.coalesce("schema_ref", F.lit("")) != "").withColumn("module", schema_ref_module(F.col("schema_ref")))
    return wanted.join(lock.select("module"), "module", "left_anti")


def unlocked_modules(refs: DataFrame, lock: DataFrame) -> DataFrame:
    """Modules referenced anywhere but not locked."""
    return unlocked(refs, lock).select("module").distinct()


def first_per_module(refs: DataFrame) -> DataFrame:
    """The first reference to each module in order of ``position``; a partial aggregate, no window. No reference is
    in no module."""
    return refs.filter("schema_ref IS NOT NULL").groupBy(schema_ref_module(F.col("schema_ref")).alias("module")).agg(
        F.min_by("schema_ref", "position").alias("schema_ref"), F.min("position").alias("position")
    )


def listing(datasets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Datasets and jobs as one table of records."""
    columns = ["namespace", "name", "owner"]
    both = datasets.select(*columns, F.lit("dataset").alias("type")).unionByName(
        jobs.select(*columns, F.lit("job").alias("type"))
    )
    return both.select(record_id(F.col("namespace"), F.col("name")).alias("id"), "type", *columns)


def list_records(records: DataFrame, namespace: str | None = None, kind: str | None = None) -> DataFrame:
    return search(records, namespace=namespace, kind=kind)


def record_of(data: DataFrame, contract: Contract, namespace: str, owner: str | None, freshness: str | None = None) -> DataFrame:
    """Catalog record of a dataset: its contract together with a profile of its rows, read in one pass."""
    from weirgate.operators.quality import NULL_RATE, profile

    measured = profile(data, freshness=freshness)
    fields = F.array(
        *[
            F.struct(F.lit(f.name).alias("name"), F.lit(f.type).alias("type"), F.lit(f.pii).alias("pii"))
            for f in contract.fields
        ]
    ) if contract.fields else F.array().cast("array<struct<name:string,type:string,pii:boolean>>")
    rates = F.map_from_arrays(
        F.array(*[F.lit(f.name) for f in data.schema.fields]),
        F.array(*[F.col(NULL_RATE + f.name) for f in data.schema.fields]),
    )
    return measured.select(
        record_id(F.lit(namespace), F.lit(contract.name)).alias("id"),
        F.lit("dataset").alias("type"),
        F.lit(namespace).alias("namespace"),
        F.lit(contract.name).alias("name"),
        F.lit(owner).cast(T.StringType()).alias("owner"),
        F.lit(contract.classification).cast(T.StringType()).alias("classification"),
        F.struct(fields.alias("fields"), F.lit(contract.format).alias("format")).alias("schema"),
        F.struct(F.col("row_count").alias("rowCount"), F.col("freshness"), rates.alias("nullRate")).alias("quality"),
    )
