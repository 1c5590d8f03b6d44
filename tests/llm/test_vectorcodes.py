"""Vector codes: bounds and whole runs against plain integer k-means."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from weirgate.llm.vectorcodes import Bounds, _down, _up, adapted, codebooks_digest, compress, first_bounds, moved_entries, next_bounds, squares, with_label_error

ROWS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("x", T.StringType()),
        T.StructField("own", T.IntegerType()),
    ]
)


def nearest(x, books):
    return np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(len(books))], axis=1)


def updated(x, books, own):
    new = books.copy()
    for p in range(books.shape[0]):
        for e in range(books.shape[1]):
            members = x[own[:, p] == e, p]
            if len(members):
                new[p, e] = [int(c) // len(members) for c in members.sum(axis=0)]
    return new


def sums_of(x, own):
    sums = {}
    for p in range(own.shape[1]):
        for e in set(own[:, p].tolist()):
            members = x[own[:, p] == e, p]
            sums[p, e, -1] = len(members)
            sums |= {(p, e, j): int(v) for j, v in enumerate(members.sum(axis=0))}
    return sums


@pytest.mark.parametrize("seed", range(12))
def test_bounds_never_hide_a_nearer_entry(seed):
    r = np.random.default_rng(seed)
    n, width, k = int(r.integers(1, 400)), int(r.integers(1, 6)), int(r.integers(1, 40))
    x = r.integers(-(span := int(r.choice([2, 6, 1000]))), span + 1, (n, 4, width))  # small spans make many ties
    books = x[:k].transpose(1, 0, 2).copy()
    near = min(5, books.shape[1] - 1)
    bounds, _ = first_bounds(x, books, near)
    for _ in range(6):
        assert (bounds.own == nearest(x, books)).all()
        new = moved_entries(books, sums_of(x, bounds.own))
        assert (new == updated(x, books, bounds.own)).all()
        moves, books = np.sqrt(((new - books) ** 2).sum(axis=2)) * (1 + 1e-6), new
        rounded = Bounds(bounds.own, _up(bounds.upper), bounds.near, _down(bounds.lower))
        bounds, needed = next_bounds(x, books, moves, rounded, min(int(r.integers(0, 12)), books.shape[1] - 1))
    assert (bounds.own == nearest(x, books)).all()


def test_settled_entries_need_no_distance():
    r = np.random.default_rng(5)
    x = (r.integers(0, 6, (300, 4, 1)) * 1000 + r.integers(-9, 10, (300, 4, 3))).astype(np.int64)
    books = np.stack([np.arange(6)[:, None] * 1000 + np.zeros(3, int) for _ in range(4)])
    bounds, _ = first_bounds(x, books, 3)
    _, needed = next_bounds(x, books, np.zeros((4, 6)), bounds, 3)
    assert not needed.any()


def test_squares_are_exact_when_large():
    x = np.array([[1 << 24, -(1 << 24), 12345677] * 4])
    c = np.array([[-(1 << 24), 1 << 24, 7] * 4])
    assert squares(x, c)[0, 0] == sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], c[0]))


def test_adapted():
    assert adapted(16, {255: 100}, 256) == 32
    assert adapted(32, {255: 100}, 256) == 32
    assert adapted(16, {0: 990, 3: 9, 9: 1}, 256) == 4
    assert adapted(16, {0: 900, 9: 100}, 256) == 10
    assert adapted(16, {255: 100}, 8) == 7


def expected(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    size = max(len(r[1]) for r in kept)
    width = max(-(-size // parts), 1)
    x = np.zeros((len(kept), parts * width), np.int64)
    for i, r in enumerate(kept):
        x[i, : len(r[1])] = [max(-(1 << 24), min(1 << 24, math.floor(1024 * v))) for v in r[1]]
    x = x.reshape(-1, parts, width)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = x[first].transpose(1, 0, 2)
    for _ in range(rounds):
        books = updated(x, books, nearest(x, books))
    own = nearest(x, books)
    errors = ((x - books[np.arange(parts), own]) ** 2).sum(axis=(1, 2))
    by_label = {}
    for r, e in zip(kept, errors.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    codes = ["".join(f"{e:02x}" for e in row) for row in own.tolist()]
    return sorted([(r[0], c, e, by_label[r[2]]) for r, c, e in zip(kept, codes, errors.tolist())], key=repr), books


def compared(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    coded, books = compress(df, carry=("label",))
    found = sorted((tuple(r) for r in with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()), key=repr)
    wanted, wanted_books = expected(rows)
    assert (books == wanted_books).all()
    assert found == wanted


def test_codes_against_plain_rounds(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 24))
    rows = [(int(i * 7 % 3000), [float(np.float32(v)) for v in centres[i % 30] + r.normal(scale=0.2, size=24)], int(i % 5) or None, "x", 1) for i in range(3000)]
    odd = [(9001, None, 1, "", 0), (9002, [float("nan")] * 24, 1, "", 0), (9003, [None] * 24, 1, "", 0), (9004, [float("inf")] * 24, 2, "", 0), (None, [0.5] * 24, None, "", 0)]
    compared(spark, rows + odd + rows[:3] + [(rows[0][0], rows[1][1], 4, "", 0)])


def test_few_mixed_and_huge_vectors(spark):
    compared(spark, [(3, [1.0, 2.0, 3.0], 1, "", 0), (1, [1.0], None, "", 0), (2, [], None, "", 0), (4, [3e38, -3e38, 0.25, 5.0, 1.0], 1, "", 0)])
    compared(spark, [(1, [], 1, "", 0)])
    compared(spark, [(1, [0.5] * 8, 1, "", 0)] * 40)


def test_no_rows(spark):
    coded, books = compress(spark.createDataFrame([(1, None, 1, "", 0)], ROWS), carry=("label", "x", "own"))
    assert coded.columns == ["vec_id", "label", "x", "own", "code", "error"] and coded.count() == 0
    assert codebooks_digest(books) == codebooks_digest(np.zeros((4, 0, 3), np.int64))
    assert with_label_error(coded).count() == 0
