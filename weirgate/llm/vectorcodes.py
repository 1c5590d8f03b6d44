"""Compression of vectors to codes: product quantization with integer k-means under Drake-Hamerly adaptive bounds.

Vectors are scaled to integers and cut into equal parts, each with a codebook. Every round assigns each part to
its nearest entry and moves each entry to the floored mean of its parts. Between rounds each part keeps, in a
written table, an upper bound of the distance to its entry, the ``near`` next closest entries with lower bounds in
ascending order, and one outer bound for all other entries. When entries move, the upper bound grows by the move
of the own entry, each lower bound falls by the move of its entry, and the outer bound by the largest move. A part
whose upper bound stays below its first lower bound keeps its entry without a distance. Otherwise the distance to
the own entry is computed; if that is not enough, the distances to the first few near entries, up to the first
lower bound above it; and only when the outer bound is reached too, all of them. Distances are exact squares of
integers, so ties go to the lower index; bounds are rounded away from a wrong decision. ``near`` adapts after each
round to what the round needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import Newest, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
NEAR, LEAST_NEAR, MOST_NEAR = 16, 4, 32
LIMIT = 1 << 24
SLICE_ROWS = 2048
UP, DOWN = np.float64(1 + 1e-6), np.float64(1 - 1e-6)
ALL = 255  # in ``needed``: the distances to all entries


@dataclass
class Bounds:
    """What is kept of ``n`` vectors, by vector and part: own entry, its upper bound, near entries, lower bounds."""

    own: np.ndarray  # n, parts
    upper: np.ndarray  # n, parts
    near: np.ndarray  # n, parts, b
    lower: np.ndarray  # n, parts, b + 1: the last is the outer bound


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 4 * int(most) ** 2 * max(x.shape[1], 1) < 1 << 53 else np.int64
    a, c = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def _each(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to its own entries (rows, b, width)."""
    apart = x[:, None, :] - entries
    return np.einsum("ijk,ijk->ij", apart, apart)


def _ordered(lower: np.ndarray) -> np.ndarray:
    """Lower bounds in ascending order: each one bounds its own entry and all later ones."""
    return np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]


def _from_all(x: np.ndarray, entries: np.ndarray, b: int):
    """Own entry, its bound, near entries and lower bounds from the distances to all entries."""
    all_squares = squares(x, entries)
    k = len(entries)
    own = all_squares.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(all_squares[rows, own]) * UP
    near, lower = np.zeros((len(x), b), np.uint8), np.full((len(x), b + 1), np.inf)
    others = all_squares.astype(np.float64)
    others[rows, own] = np.inf
    m = min(b + 1, k - 1)
    if m > 0:
        found = np.argpartition(others, m - 1, axis=1)[:, :m]
        order = np.argsort(np.take_along_axis(others, found, axis=1), axis=1)
        found = np.take_along_axis(found, order, axis=1)
        lower[:, :m] = np.sqrt(np.take_along_axis(others, found, axis=1)) * DOWN
        near[:, : min(m, b)] = found[:, :b]
    return own, upper, near, lower


def first_bounds(x: np.ndarray, books: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds from all distances, for vectors (n, parts, width) and codebooks (parts, entries, width)."""
    found = [_from_all(x[:, p], books[p], b) for p in range(books.shape[0])]
    return Bounds(*(np.stack(each, axis=1) for each in zip(*found))), np.full(x.shape[:2], ALL, np.uint8)


def resized(bounds: Bounds, b: int) -> Bounds:
    """Bounds with ``b`` near entries: fewer make the first one left out the outer bound, more are filled with it."""
    now = bounds.near.shape[2]
    if b <= now:
        return Bounds(bounds.own, bounds.upper, bounds.near[:, :, :b], bounds.lower[:, :, : b + 1])
    fill = ((0, 0), (0, 0), (0, b - now))
    return Bounds(bounds.own, bounds.upper, np.pad(bounds.near, fill), np.pad(bounds.lower, fill, mode="edge"))


def next_bounds(x: np.ndarray, books: np.ndarray, moves: np.ndarray, bounds: Bounds, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds after the entries moved by ``moves`` (parts, entries), and how many near entries each part needed."""
    bounds = resized(bounds, b)
    own, upper = bounds.own.astype(np.int64), bounds.upper.astype(np.float64)
    near, lower = bounds.near.copy(), bounds.lower.astype(np.float64)
    needed = np.zeros(own.shape, np.uint8)
    for p in range(books.shape[0]):
        entries, moved, vectors = books[p], moves[p], x[:, p]
        up = (upper[:, p] + moved[own[:, p]]) * UP
        low = lower[:, p].copy()
        low[:, :b] -= moved[near[:, p]]
        low[:, b] -= moved.max(initial=0)
        # a filler's place holds the outer bound, which falls by the largest move
        low[:, :b] = np.where(lower[:, p, :b] >= lower[:, p, b:], np.minimum(low[:, :b], low[:, b:]), low[:, :b])
        low = _ordered(low * np.where(low > 0, DOWN, UP))
        open_rows = np.flatnonzero(up >= low[:, 0])
        if len(open_rows):
            exact = _each(vectors[open_rows], entries[own[open_rows, p]][:, None, :])[:, 0]
            up[open_rows] = np.sqrt(exact) * UP
            still = up[open_rows] >= low[open_rows, 0]
            needed[open_rows, p] = 1
            rows, exact = open_rows[still], exact[still]
            if len(rows):
                count = (up[rows, None] >= low[rows]).sum(axis=1)  # bounds are in order, so these come first
                everything = rows[count > b]
                some = count <= b
                rows, exact, count = rows[some], exact[some], count[some]
                needed[rows, p] = np.minimum(count, ALL - 1)
                needed[everything, p] = ALL
                if len(everything):
                    o, u, n, w = _from_all(vectors[everything], entries, b)
                    own[everything, p], up[everything], near[everything, p], low[everything] = o, u, n, w
                if len(rows):
                    most = int(count.max())
                    tried = near[rows, p, :most].astype(np.int64)
                    apart = _each(vectors[rows], entries[tried])
                    live = np.arange(most) < count[:, None]
                    # own entry and the tried ones by distance, then index; the rest stay where they are
                    ids = np.concatenate((own[rows, p][:, None], tried), axis=1)
                    dist = np.concatenate((exact[:, None], apart), axis=1)
                    live = np.concatenate((np.ones((len(rows), 1), bool), live), axis=1)
                    place = np.broadcast_to(np.arange(most + 1), ids.shape)
                    order = np.lexsort((np.where(live, ids, place), np.where(live, dist, np.iinfo(np.int64).max), ~live), axis=1)
                    ids, dist, live = (np.take_along_axis(v, order, axis=1) for v in (ids, dist, live))
                    own[rows, p] = ids[:, 0]
                    up[rows] = np.sqrt(dist[:, 0]) * UP
                    near[rows, p, :most] = ids[:, 1:]
                    low[rows, :most] = np.where(live[:, 1:], np.sqrt(dist[:, 1:]) * DOWN, low[rows, :most])
                    low[rows] = _ordered(low[rows])
        upper[:, p], lower[:, p] = up, low
    return Bounds(own, upper, near, lower), needed


# ---- tables ----


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """Scaled vectors (n, width) of a list column; short ones are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
    return out


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    n = len(x)
    width = x.dtype.itemsize * (x.size // n if n else 0)
    return pa.array([memoryview(row) for row in np.frombuffer(np.ascontiguousarray(x).tobytes(), f"V{width}")] if width else [b""] * n, pa.binary())


def _rows(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


STATE = ("x", "own", "upper", "near", "lower", "needed")


def _assign(books: np.ndarray, moves: np.ndarray | None, kind: str, now: int, then: int, last: bool):
    """Batches to the next state, or to codes and errors in the last round."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                if moves is None:
                    x = _integers(part.column(1), parts * width).reshape(-1, parts, width)
                    bounds, needed = first_bounds(x, books, then)
                else:
                    x = _rows(part.column(1), kind, parts, width).astype(np.int64)
                    kept = Bounds(
                        _rows(part.column(2), np.uint8, parts),
                        _rows(part.column(3), np.float32, parts),
                        _rows(part.column(4), np.uint8, parts, now),
                        _rows(part.column(5), np.float32, parts, now + 1),
                    )
                    bounds, needed = next_bounds(x, books, moves, kept, then)
                if last:
                    own = bounds.own.astype(np.int64)
                    apart = x - books[np.arange(parts), own]
                    codes = [row.tobytes().hex() for row in own.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(codes, pa.string()), pa.array((apart * apart).sum(axis=(1, 2)), pa.int64())],
                        names=["row", "code", "error"],
                    )
                else:
                    values = (x.astype(kind), bounds.own.astype(np.uint8), _up(bounds.upper), bounds.near.astype(np.uint8), _down(bounds.lower), needed)
                    yield pa.RecordBatch.from_arrays([part.column(0), *map(_binary, values)], names=["row", *STATE])

    return run


def _sums(kind: str, parts: int, entries: int, width: int):
    """Partial sums of a task: (part, entry, place, value); place -1 counts parts, part -1 counts what was needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, needed = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros(256, np.int64)
        for batch in batches:
            x, own = _rows(batch.column(0), kind, parts, width), _rows(batch.column(1), np.uint8, parts)
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                ids, starts = np.unique(own[order, p], return_index=True)
                sums[p, ids] += np.add.reduceat(x[order, p].astype(np.int64), starts, axis=0) if len(order) else 0
                counts[p] += np.bincount(own[:, p], minlength=entries)
            needed += np.bincount(_rows(batch.column(2), np.uint8, parts).ravel(), minlength=256)
        columns = []
        p, e = np.nonzero(counts)
        columns.append((np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), sums[p, e].ravel()))
        columns.append((p, e, np.full(len(p), -1), counts[p, e]))
        z = np.flatnonzero(needed)
        columns.append((np.full(len(z), -1), z, np.full(len(z), -1), needed[z]))
        arrays = [np.concatenate(c) for c in zip(*columns)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()) for a in arrays[:3]] + [pa.array(arrays[3], pa.int64())], names=["part", "entry", "place", "value"])

    return run


def moved_entries(books: np.ndarray, sums: dict[tuple[int, int, int], int]) -> np.ndarray:
    """Codebooks with each used entry at the floored mean of its parts."""
    new = books.copy()
    for (p, e, place), value in sums.items():
        if p >= 0 and place >= 0:
            new[p, e, place] = value // sums[p, e, -1]
    return new


def adapted(near: int, needed: dict[int, int], entries: int) -> int:
    """Near entries for the next round: as many as sufficed for 99 % of the parts, twice as many if 5 % needed all."""
    total = sum(needed.values())
    if needed.get(ALL, 0) > 0.05 * total:
        wanted = 2 * near
    else:
        wanted, covered = near, total
        for z in sorted((z for z in needed if z != ALL), reverse=True):
            if total - covered + needed[z] > 0.01 * total - needed.get(ALL, 0):
                wanted = z + 1
                break
            covered -= needed[z]
    return max(0, min(max(LEAST_NEAR, min(wanted, MOST_NEAR)), entries - 1))


def finite(vector) -> F.Column:
    """Whether a list column holds numbers only: no null, no NaN, no infinity."""
    c = F.col(vector)
    return c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    carry: tuple[str, ...] = (),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts, entries, width) they refer to.

    The table has ``key``, ``carry``, ``code`` (two hex digits a part) and ``error`` (squared distance to what the
    code stands for, summed over the parts). Rows whose vector is null, or holds a component that is null or not
    finite, are left out. The codebooks start with the vectors of the ``entries`` smallest keys, null keys last,
    equal keys by vector; with fewer rows they have fewer entries. Vectors shorter than the longest, or than a
    multiple of ``parts``, are filled with zeros. Scaled components beyond 2^24 either way count as 2^24. Rows with
    equal keys or vectors are rows of their own. Without rows the table is empty and the codebooks have no entry.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries are needed")
    spark = vectors.sparkSession
    kept = vectors.where(finite(vector)).select(F.struct(key, *carry).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    size, most = kept.agg(F.max(F.size("v")), F.max(top)).first()
    form = f"row {kept.schema['row'].dataType.simpleString()}"
    if size is None:
        return spark.createDataFrame([], f"{form}, code string, error long").select("row.*", "code", "error"), np.zeros((parts, 0, 0), np.int64)
    width = max(-(-size // parts), 1)
    start = kept.orderBy(F.col(f"row.{key}").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = _integers(start, parts * width).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    kind = "<i2" if (most or 0) * SCALE < 32_000 else "<i4"
    near, states, moves, state = min(NEAR, books.shape[1] - 1), Newest(spark, "vector-bounds"), None, kept
    now, state_is_old = near, False
    columns = ", ".join(f"{c} binary" for c in STATE)
    for _ in range(rounds):
        state = states.keep(state.mapInArrow(_assign(books, moves, kind, now, near, False), f"{form}, {columns}"))
        now = near
        partial = state.select("x", "own", "needed").mapInArrow(
            _sums(kind, parts, books.shape[1], width), "part int, entry int, place int, value long"
        )
        sums = {(r[0], r[1], r[2]): r[3] for r in partial.groupBy("part", "entry", "place").agg(F.sum("value")).collect()}
        new = moved_entries(books, sums)
        moves = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * UP
        if state_is_old:  # the first round computes all distances in any case
            near = adapted(near, {e: n for (p, e, _), n in sums.items() if p < 0}, books.shape[1])
        books, state_is_old = new, True
    coded = state.mapInArrow(_assign(books, moves, kind, now, near, True), f"{form}, code string, error long")
    coded = stored(coded, "vector-codes")
    states.drop()
    return coded.select("row.*", "code", "error"), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over the rows of an equal label; null labels are equal."""
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
