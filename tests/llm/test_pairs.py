"""Jaccard classes, substring dedup and vector near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from weirgate.llm import jaccard
from weirgate.llm.jaccard import jaccard_classes
from weirgate.llm.neardup import near_duplicates
from weirgate.llm.substring import anchor_plan, difference_cover, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 60 + 17 * i) for i in range(8)]
    near = [edited(b, 100 * i + k, k) for i, b in enumerate(base) for k in range(1, 6)]
    passage = prose(99, 70)
    shared = [f"{prose(200 + i, 30)} {passage} {prose(300 + i, 25)}" for i in range(10)]
    odd = [None, "", "  \t ", "One two", "one TWO", "a b c d e", "A b c d e", base[0], base[0], prose(7, 3000), "é" * 50]
    out = base + near + shared + odd
    random.Random(5).shuffle(out)
    return out


def sets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def classes(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_jaccard_classes(spark, texts):
    own = [sets(t) for t in texts]
    want = classes(len(texts), lambda i, j: bool(own[i] and own[j]) and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]))
    got = {r["doc_id"]: r for r in jaccard_classes(docs(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in own]


def test_jaccard_chain_is_one_class(spark):
    """Neighbours link, ends do not: a class is found through its links."""
    base = prose(1, 200, 10_000).split()
    chain = [" ".join(f"y{k}_{i}" if i < 6 * k else w for i, w in enumerate(base)) for k in range(8)]
    got = {r["component_id"] for r in jaccard_classes(docs(spark, chain)).collect()}
    own = [sets(t) for t in chain]
    want = set(classes(8, lambda i, j: 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j])))
    assert got == want


def test_jaccard_edges(spark):
    df = docs(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")]).withColumn("s", F.lit(1)).withColumn("component_id", F.lit(0))
    rows = sorted((tuple(r) for r in jaccard_classes(df).collect()), key=repr)
    assert rows == [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, 5)]
    assert jaccard_classes(docs(spark, [])).collect() == []


def test_jaccard_long_texts_that_do_not_link_are_not_shipped(spark, monkeypatch):
    """Texts of 2,100 shingles with 0.67 in common: a sketch of 1,024 bits can't tell them from those that link."""
    shipped, stored = [], jaccard.stored

    def counted(df, label):
        out = stored(df, label)
        if label == "pairs":
            shipped.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    base = prose(1, 2104, 10**6)
    cut = base.split()
    texts = [base, *(" ".join([f"y{k}_{i}" if i < 420 else w for i, w in enumerate(cut)]) for k in range(6)), edited(base, 3, 5)]
    got = [r["component_id"] for r in jaccard_classes(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 0]
    assert sum(shipped) == 1


def test_jaccard_groups_out_of_reach_do_not_meet(spark):
    """Sets of 400 that share 20 of 100 prefix shingles can't link, however many they are; with 60 of them two can."""
    rows = [(t, g, g, 400, 80 + t) for g in range(300) for t in range(20)]
    rows += [(100 + t, g, g, 400, 40 + t) for g in (1000, 1001) for t in range(60)]
    lists = spark.createDataFrame(rows, "token long, g long, c long, n long, pos int")
    assert [tuple(r) for r in jaccard._met(lists, 75).collect()] == [(1000, 1000, 1001, 1001)]


def brute_repeats(rows, size):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                keep[p : p + size] = [False] * size
        out.append((i, len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)))
    return out


@pytest.mark.parametrize("size", [50, 12])
def test_repeats(spark, texts, size):
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[0]), (7, prose(99, 70)), (10**9, f"{texts[1]} {texts[1]}")]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"] or "") for r in remove_repeats(docs(spark, rows), size=size).collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(rows, size), key=repr)


def test_repeats_of_nothing(spark):
    assert remove_repeats(docs(spark, [])).collect() == []
    kept = remove_repeats(docs(spark, [None, "a  b"]), carry=("text", "lang")).orderBy("doc_id").collect()
    assert [(r["text"], r["kept"]) for r in kept] == [(None, None), ("a  b", "a b")]


@pytest.mark.parametrize("size", range(2, 60, 7))
def test_any_two_places_share_an_anchor(size):
    residues, length = anchor_plan(size)
    period = len(residues)
    assert length + period - 1 == size
    for a in range(period):
        for b in range(period):
            assert any(residues[(a + d) % period] and residues[(b + d) % period] for d in range(period))
    assert difference_cover(7)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, id int")


def test_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(150, 64))
    rows = [base[i] for i in range(150)]
    for i in range(25):  # from far below the bound to equal
        for share in (0.0, 0.1, 0.3, 0.45, 0.6):
            rows.append(base[i] + share * r.normal(size=64))
    rows += [base[0]] * 40 + [2 * base[1], -base[2]]
    x = np.array(rows, dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    bad = [None, np.zeros(64), np.full(64, np.nan), [np.inf] * 64, [1.0, 2.0]]
    got = {q["vec_id"]: q for q in near_duplicates(vectors(spark, [*enumerate(rows), *((1000 + i, b) for i, b in enumerate(bad))])).collect()}
    assert len(got) == len(rows) + len(bad)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= link.sum(axis=1)).all()
    assert found.sum() >= 0.97 * link.sum()
    copies = [i for i in range(len(rows)) if i == 0 or 275 <= i < 315]
    assert {got[i]["component_id"] for i in copies} == {0}
    for i in range(len(bad)):
        assert (got[1000 + i]["n_links"], got[1000 + i]["component_id"], got[1000 + i]["kept"]) == (0, 1000 + i, True)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(vectors(spark, [])).collect() == []
    one = near_duplicates(vectors(spark, [(4, None)])).collect()
    assert [tuple(r) for r in one] == [(4, 0, 4, True)]


def test_near_duplicates_of_a_repeated_key_with_other_vectors(spark):
    a, b, c = np.eye(8)[:3]
    rows = [(1, a), (1, b), (2, a + 0.1 * c), (3, b), (4, c), (4, -c), (1, a)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(vectors(spark, rows)).collect())
    assert got == [(1, 1, 3, False), (1, 2, 2, False), (1, 2, 2, False), (2, 2, 2, True), (3, 1, 3, True), (4, 0, 4, True), (4, 0, 4, True)]


def test_near_duplicates_of_every_length(spark):
    r = np.random.default_rng(5)
    long, short = r.normal(size=(40, 64)), r.normal(size=(3, 16))
    rows = [*enumerate(long), (50, short[0]), (51, short[0]), (52, 3 * short[0] + 0.01), (53, short[1]), (54, [2.0]), (55, [3.0]), (56, [-1.0])]
    got = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in near_duplicates(vectors(spark, rows)).collect()}
    assert [got[i] for i in range(50, 57)] == [(2, 50), (2, 50), (2, 50), (0, 53), (1, 54), (1, 54), (0, 56)]
    assert all(got[i] == (0, i) for i in range(40))
