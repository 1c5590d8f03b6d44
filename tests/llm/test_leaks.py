"""Leaked items with numbers of edits that are given here, not taken from the operator."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import docs, prose
from tests.llm.test_texts import brute_distance
from weirgate.llm import decontaminate


def edited(r, words, substituted=0, inserted=0, dropped=0):
    """``words`` with so many edits at different places, none of them at an end."""
    words, kinds = list(words), ["s"] * substituted + ["i"] * inserted + ["d"] * dropped
    r.shuffle(kinds)
    for place, kind in zip(sorted(r.sample(range(1, len(words) - 1), len(kinds)), reverse=True), kinds):
        words[place : place + (kind != "i")] = [] if kind == "d" else [f"zz{r.randrange(50)}"]
    return words


def check_found(spark, cases, seed):
    """Each case is words of the item, substituted, inserted and dropped words; all have to be found."""
    r = random.Random(seed)
    items = [(i, prose(seed * 1000 + i, case[0], 3000)) for i, case in enumerate(cases)]
    texts = []
    for (i, item), (_, *edits) in zip(items, cases):
        words = edited(r, item.split(), *edits)
        texts.append(" ".join([*prose(7000 + i, 25, 3000).split(), *words, *prose(8000 + i, 25 * (i % 3), 3000).split()]))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(row["doc_id"], m["item"]): m for row in decontaminate.find_items(docs(spark, texts), table).collect() for m in row["matches"]}
    assert [case for i, case in enumerate(cases) if (i, i) not in got] == []
    for (d, i), m in got.items():
        words, item = texts[d].split(), items[i][1].split()
        assert brute_distance(words[m["first_word"] : m["first_word"] + m["words"]], item) == m["distance"] <= sum(cases[d][1:])


def test_an_inserted_or_dropped_word_is_one_edit(spark):
    one = [(n, 0, *e) for n in (10, 12, 15, 17, 19) for e in ((1, 0), (0, 1))]
    two = [(n, *e) for n in (20, 24, 29) for e in ((1, 1, 0), (1, 0, 1), (0, 2, 0), (0, 0, 2), (0, 1, 1))]
    more = [(n, *e) for n in (40, 49) for e in ((2, 2, 0), (0, 4, 0), (0, 0, 4), (1, 1, 2))]
    check_found(spark, (one + two + more) * 3, 5)


def test_up_to_15_percent_edits(spark):
    short = [(n, *e) for n in (7, 8, 9) for e in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    middle = [(n, *e) for n in (14, 15, 17, 19) for e in ((2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0))]
    long = [(n, *e) for n in (30, 33) for e in ((4, 0, 0), (0, 4, 0), (2, 1, 1))] + [(47, 7, 0, 0), (54, 2, 3, 3)]
    check_found(spark, (short + middle + long) * 2, 6)


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_closest_windows_against_all_windows(n):
    r = np.random.default_rng(n)
    a, b = r.integers(1, 4, (60, n + 4)).astype(np.uint64), r.integers(1, 4, (60, n)).astype(np.uint64)
    lengths = r.integers(0, n + 5, 60)
    distance, first, count = decontaminate.closest_windows(np.where(np.arange(n + 4) < lengths[:, None], a, 0), lengths, b)
    for k in range(60):
        found = [(brute_distance(list(a[k, i:j]), list(b[k])), i, j - i) for i in range(lengths[k] + 1) for j in range(i, lengths[k] + 1)]
        assert distance[k] == min(found)[0]
        if distance[k] < n:
            assert (distance[k], first[k], count[k]) == min(found)


def test_search_draws_its_walks_once(monkeypatch):
    """The places of walks and samples depend on an item's size alone; drawing them for each batch took much of the time."""
    item = " ".join(f"w{i}" for i in range(20))
    texts = [item, f"before {item} after", " ".join(f"w{i}" for i in range(18)), f"x {item}"]
    index = decontaminate.Index([7], [item], decontaminate.SHARE)

    def found():
        return sorted({m for w in decontaminate.word_slices(pa.array(texts), lower=True) for m in index.find(w)})

    first = found()
    assert set(first) == {(0, 7, 0, 0, 20), (1, 7, 0, 1, 20), (2, 7, 2, 0, 18), (3, 7, 0, 1, 20)}
    monkeypatch.setattr(np.random, "default_rng", None)
    assert found() == first
