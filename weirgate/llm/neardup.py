"""Near-duplicate vectors through a pivot-permutation index.

``PIVOTS`` reference points for each length of vectors are taken from the rows (those first by a hash of the id, a
bounded sample); every row is indexed. A vector is described by its ``NEAREST`` nearest pivots in order. The inverted lists are kept by
``SHARED`` pivots together rather than by one: two vectors meet in a list exactly when they have that many
pivots in common. Vectors of one list are compared in blocks of bounded size, each pair only in the list of
their first common pivots, and verified in double precision. A cell of two blocks returns one row for each
vector, with the number of its links and a label of the class inside the cell, never pairs.

Equal vectors are one entry with a count, so copies cost nothing after the first step. Entries have numbers of
their own, as an id may be repeated with other vectors; classes get ids at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import components, stored

PIVOTS = 256
NEAREST = 9
SHARED = 3
BLOCK = 128
COSINE = 0.9


def _vectors(column: pa.Array) -> list[np.ndarray]:
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    flat, at = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[at[i] : at[i + 1]] for i in range(len(column))]


def _usable(v: np.ndarray) -> bool:
    return bool(len(v)) and bool(np.isfinite(v).all()) and bool(v.any())


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _describe(pivots: dict[int, np.ndarray]):
    """All rows; the usable ones with a digest of the vector, their nearest pivots and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, near, kept = batch.column(1).to_pylist(), [], [], []
            for i, v in enumerate(_vectors(batch.column(2))):
                usable = ids[i] is not None and _usable(v)
                digests.append(xxhash.xxh3_128_digest((v + 0.0).tobytes()) if usable else None)
                near.append(np.argsort(-(pivots[len(v)] @ _unit(v)), kind="stable")[:NEAREST].tolist() if usable else None)
                kept.append(v if usable else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(near, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.float64()))],
                names=["key", "id", "same", "near", "v"],
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inverted lists of each entry: its length, and every ``SHARED`` of its pivots, packed into one number."""
    for batch in batches:
        ids, dims, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_pylist()
        pivots = np.array([len(n) for n in lists])
        for m in np.unique(pivots).tolist():  # fewer than NEAREST where a length has fewer pivots
            rows = np.flatnonzero(pivots == m)
            near = np.sort(np.array([lists[i] for i in rows], dtype=np.int64), axis=1)
            parts = near[:, np.array(list(combinations(range(m), min(SHARED, m))))]
            packed = np.zeros(parts.shape[:2], dtype=np.int64)
            for k in range(parts.shape[2]):
                packed = packed * PIVOTS + parts[:, :, k]
            each = packed.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(dims[rows], each), pa.int32()), pa.array(packed.ravel(), pa.int64()), pa.array(np.repeat(ids[rows], each), pa.int64())], names=["dim", "key", "id"]
            )


def _compare(cosine: float):
    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        key = cell.column("key")[0].as_py()
        last = key % PIVOTS
        ids, block, copies = cell.column("id").to_numpy(), cell.column("block").to_numpy(), cell.column("copies").to_numpy()
        x = np.array([_unit(np.asarray(v)) for v in cell.column("v").to_pylist()])
        near = cell.column("near").to_pylist()
        shared = min(SHARED, min(len(n) for n in near))
        below = np.zeros((len(ids), PIVOTS), dtype=np.float32)
        for i, n in enumerate(near):
            below[i, [p for p in n if p < last]] = 1
        # the pair belongs to this list if its common pivots up to the last of the key are the key
        own = below @ below.T == shared - 1
        own &= (x @ x.T >= cosine) & (ids[:, None] != ids[None, :])
        if cell.column("one")[0].as_py() != cell.column("two")[0].as_py():
            own &= block[:, None] != block[None, :]
        n = own @ copies
        label = ids.copy()
        while True:
            lowest = np.where(own, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            new = np.minimum(label, lowest)
            if (new == label).all():
                break
            label = new
        some = n > 0
        return pa.table({"id": ids[some], "n": n[some].astype(np.int64), "to": label[some]})

    return run


def choose_pivots(rows: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each length of vectors, unit vectors of usable rows, those first by a hash of the id."""
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    usable = rows.where("id is not null and v is not null").where(finite)
    out: dict[int, np.ndarray] = {}
    for size in sorted(r["size"] for r in usable.select(F.size("v").alias("size")).distinct().collect()):
        kept: list[np.ndarray] = []
        for r in usable.where(F.size("v") == size).orderBy(F.xxhash64("id"), "id", "v").limit(4 * most).collect():
            v = _unit(np.array(r["v"], dtype=np.float64))
            if len(kept) < most and (not kept or (np.array(kept) @ v).max() < COSINE):  # near copies of a pivot describe nothing new
                kept.append(v)
        out[size] = np.array(kept)
    return out


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``table``: the key, ``n_links``, ``component_id`` and ``kept``.

    Links join vectors with a cosine of at least ``cosine`` that share pivots; ``n_links`` counts the other rows
    linked, copies included. Vectors that are null, zero or not finite somewhere link with nothing, and so do rows
    without a key; vectors of different lengths don't link. Rows that repeat a key are rows of their own, each with
    the links and class of its vector. A class is named by its smallest key that is in no other class, or by its
    smallest key where there is none. Other columns are ignored. Recall against brute force is measured in the tests.
    """
    rows = table.select(F.col(key).alias("key"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    pivots = choose_pivots(rows)
    if not pivots:
        return table.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.col(key).isNotNull().alias("kept"))
    kind = rows.schema["key"].dataType.simpleString()
    described = stored(rows.mapInArrow(_describe(pivots), f"key {kind}, id long, same binary, near array<int>, v array<double>"), "described")
    usable = described.where("same is not null")
    same = stored(usable.groupBy("same").agg(F.min("id").alias("first"), F.count("id").alias("copies")), "same")
    one_each = usable.join(same, "same").where("id = first").dropDuplicates(["same"])
    entries = stored(one_each.select(F.monotonically_increasing_id().alias("id"), "same", "near", "v", "copies"), "entries")
    lists = stored(entries.select("id", "near", F.size("v").alias("dim")).mapInArrow(_keys, "dim int, key long, id long"), "lists")
    sizes = stored(
        lists.groupBy("dim", "key").agg(F.count("id").alias("m")).where("m > 1").select("dim", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "sizes"
    )
    placed = lists.join(sizes, ["dim", "key"]).withColumn("block", F.expr("pmod(hash(id, key), blocks)"))
    spread = placed.select("dim", "key", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = spread.select("dim", "key", "id", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    full = stored(cells, "cells").join(entries.drop("same"), "id")
    found = stored(full.groupBy("dim", "key", "one", "two").applyInArrow(_compare(cosine), "id long, n long, to long"), "found")
    classes = components(entries.select("id"), found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    per_entry = stored(
        entries.select("id", "same", "copies").join(linked, "id", "left").join(classes, "id").select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"),
        "classes",
    )
    per_row = stored(usable.select("key", "id", "same").join(per_entry, "same").select("key", "id", "n", "component"), "rows")
    owned = stored(per_row.select("id", "component").distinct(), "owned")
    alone = owned.groupBy("id").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("m")).where("m = 1").groupBy("component").agg(F.min("id").alias("alone"))
    lowest = owned.groupBy("component").agg(F.min("id").alias("lowest"))
    named = stored(lowest.join(alone, "component", "left").select("component", F.coalesce("alone", "lowest").alias("component_id")), "named")
    both = per_row.join(named, "component").select("key", "id", "n", "component_id").union(
        described.where("same is null").select("key", "id", F.lit(0).cast("long"), "id")
    )
    return both.select(F.col("key").alias(key), F.col("n").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
