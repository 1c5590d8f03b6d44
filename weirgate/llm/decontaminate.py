"""Benchmark decontamination by CGK random-walk embeddings and bit-sampling LSH.

Texts and items are words in lower case, compared by edit distance over words. An item of n words leaks into a
text if a window of the text is within ``floor(share * n)`` edits of it.

1. A window of an item's size is a candidate only if enough of its words and word pairs occur in items at all,
   and then in items of that size. Of the n words that follow the first of a leak, each edit spoils one word and
   two pairs at most, a word pushed out of their end by an inserted one included, so nothing within the
   distance is lost.
2. Candidates and items of one size are embedded by the same random walks: at each step the current word is put
   out, and a random bit of (step, word) says whether to move on. The walk turns a small edit distance into a
   small Hamming distance, since walks that part on an edit soon fall into step again.
3. Bit-sampling LSH: each of ``TABLES`` tables of each of ``WALKS`` walks looks at ``SAMPLED`` places of the
   embedding. Where a window agrees with an item in any table, the item is compared with all windows, of
   whatever size, that begin and end up to its edits outside that window: an inserted or dropped word is one edit.

An exact copy agrees everywhere and is always found; recall within the distance is measured in the tests.
Items are taken in blocks of ``BLOCK_ITEMS``, each block one pass over the texts, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.words import BASE, Words, run_of, word_slices

SHARE = 0.15
WALKS, TABLES, SAMPLED = 6, 8, 2
BLOCK_ITEMS = 20_000
MATCHES = "array<struct<item:bigint,distance:int,first_word:bigint,words:int>>"
_TYPE = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int64()), ("words", pa.int32())]))
FILTER_BITS = 20


class _Known:
    """Whether hashes are in a set: a bit table first, then a sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bits[self.sorted >> np.uint64(64 - FILTER_BITS)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self.bits[hashes >> np.uint64(64 - FILTER_BITS)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
            out[at] = self.sorted[place] == hashes[at]
        return out


@dataclass
class _Size:
    """The items of one number of words: their ids, words, and by walk and table their keys in order."""

    ids: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    edits: int
    tables: list[list[tuple[np.ndarray, np.ndarray]]]


@lru_cache(64)
def _steps(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(0, 1 << 63, (3 * n, WALKS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1024)
def _places(n: int, walk: int) -> np.ndarray:
    return np.random.default_rng((n, walk, 1)).integers(0, n, (TABLES, SAMPLED))


def walked(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By walk, the embedding of each row of ``words``: three times as many places as a row has; 0 past its end."""
    n = words.shape[1]
    steps = _steps(n)
    padded = np.hstack([words, np.zeros((len(words), 1), np.uint64)]).ravel()
    at = np.tile(np.arange(len(words)) * (n + 1), (WALKS, 1))
    last = at + lengths
    out = np.empty((3 * n, WALKS, len(words)), dtype=np.uint64)
    for step in range(3 * n):
        word = padded.take(at)
        out[step] = word
        at = np.minimum(at + ((word * steps[step]) >> np.uint64(63)).astype(np.int64), last)
    return out.transpose(1, 2, 0)


def _keys(embedded: np.ndarray, walk: int) -> Iterator[np.ndarray]:
    for places in _places(embedded.shape[1], walk):
        key = embedded[:, places[0]]
        for place in places[1:]:
            key = key * BASE + embedded[:, place]  # of words, which are hashes already
        yield key


class Index:
    def __init__(self, ids: list[int], texts: list[str], share: float):
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        words, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for part in word_slices(pa.array(texts, pa.string()), lower=True):
            for i in range(len(part.bounds) - 1):
                own = part.hashes[part.of(i)]
                if len(own):
                    by_size.setdefault(len(own), []).append((ids[part.first + i], own))
                    words.append(own)
                    pairs.append(run_of(own, 2))
        self.words, self.pairs = _Known(np.concatenate(words)), _Known(np.concatenate(pairs))
        self.sizes: dict[int, _Size] = {}
        for n, items in sorted(by_size.items()):
            matrix = np.array([w for _, w in items])
            tables = []
            for walk, embedded in enumerate(walked(matrix, np.full(len(matrix), n))):
                tables.append([(k[o := np.argsort(k, kind="stable")], o) for k in _keys(embedded, walk)])
            self.sizes[n] = _Size(np.array([i for i, _ in items], dtype=np.int64), matrix, np.unique([run_of(w, 2) for w in matrix]), int(share * n), tables)

    def find(self, words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item, distance, first word and words of the windows that are within an item's distance."""
        h = words.hashes
        total = len(h)
        if not total or not self.sizes:
            return
        text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
        stop = words.bounds[text + 1]
        in_words = np.concatenate(([0], np.cumsum(self.words.has(h), dtype=np.int32)))
        both = run_of(h, 2)
        pair = self.pairs.has(both)
        in_pairs = np.concatenate(([0], np.cumsum(pair, dtype=np.int32), np.zeros(1, np.int32)))
        in_pairs[-1] = in_pairs[-2]
        left = stop - np.arange(total)
        tails = np.flatnonzero(left < max(self.sizes))
        for n, size in self.sizes.items():
            # whole windows by differences of neighbours, those that end with their text by place
            whole = np.flatnonzero(in_pairs[n - 1 : total] - in_pairs[: max(total - n + 1, 0)] >= n - 1 - 2 * size.edits)
            whole = whole[(left[whole] >= n) & (in_words[whole + n] - in_words[whole] >= n - size.edits)]
            short = tails[(left[tails] < n) & (left[tails] >= n - size.edits)]
            cut = stop[short]
            short = short[(in_words[cut] - in_words[short] >= n - size.edits) & (in_pairs[np.maximum(cut - 1, short)] - in_pairs[short] >= n - 1 - 2 * size.edits)]
            first = np.sort(np.concatenate((whole, short)))
            end = np.minimum(first + n, stop[first])
            if len(first) and n > 1:
                near = _pairs_within(both, first, end, size.pairs) >= n - 1 - 2 * size.edits
                first, end = first[near], end[near]
            for at in range(0, len(first), 1024):
                yield from self._verify(words, text, first[at : at + 1024], end[at : at + 1024], n, size)

    def _verify(self, words: Words, text: np.ndarray, first: np.ndarray, end: np.ndarray, n: int, size: _Size) -> Iterator[tuple[int, int, int, int, int]]:
        lengths = end - first
        found, many = [], len(size.ids)
        for walk, embedded in enumerate(walked(_spans(words.hashes, first, lengths, n), lengths)):
            agreed = []
            for key, (ordered, item) in zip(_keys(embedded, walk), size.tables[walk]):
                low = np.searchsorted(ordered, key, "left")
                hit = np.flatnonzero(ordered[np.minimum(low, many - 1)] == key)
                if len(hit):
                    low = low[hit]
                    agree = np.searchsorted(ordered, key[hit], "right") - low
                    if agree.max() > 1:
                        ends = np.cumsum(agree)
                        low = np.arange(ends[-1]) + np.repeat(low - ends + agree, agree)
                        hit = np.repeat(hit, agree)
                    agreed.append(hit * many + item[low])
            if agreed:
                found.append(np.unique(np.concatenate(agreed)))
        if found:
            pairs = np.unique(np.concatenate(found))
            for at in range(0, len(pairs), 8192):
                w, i = np.divmod(pairs[at : at + 8192], many)
                own = text[first[w]]
                low = np.maximum(first[w] - size.edits, words.bounds[own])
                room = np.minimum(first[w] + n + size.edits, words.bounds[own + 1]) - low
                spans = _spans(words.hashes, low, room, n + 2 * size.edits)
                near = np.flatnonzero(_words_within(spans, size.words[i]) >= n - size.edits)
                i, own, low = i[near], own[near], low[near]
                distance, begin, count = closest_windows(spans[near], room[near], size.words[i])
                for k in np.flatnonzero(distance <= size.edits):
                    t = int(own[k])
                    yield t, int(size.ids[i[k]]), int(distance[k]), int(low[k] + begin[k] - words.bounds[t]), int(count[k])


def _spans(hashes: np.ndarray, first: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """``lengths`` words from each of ``first``, filled up with zeros."""
    place = np.minimum(first[:, None] + np.arange(width), len(hashes) - 1)
    return np.where(np.arange(width) < lengths[:, None], hashes[place], np.uint64(0))


def _words_within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least as many as there are words in each row of ``b`` that are in the row of ``a``: words are told apart by ten bits."""
    seen, rows = np.zeros((len(a), 1024), dtype=bool), np.arange(len(a))[:, None]
    seen[rows, a >> np.uint64(54)] = True
    return seen[rows, b >> np.uint64(54)].sum(axis=1)


def _pairs_within(pairs: np.ndarray, first: np.ndarray, end: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many word pairs of each window are known."""
    places = np.unique(np.concatenate([np.arange(a, b - 1) for a, b in _joined(first, end)] or [np.zeros(0, np.int64)]))
    hit = np.zeros(len(pairs) + 1, dtype=np.int32)
    values = pairs[places]
    hit[places + 1] = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
    total = np.cumsum(hit)
    return total[np.maximum(end - 1, first)] - total[first]


def _joined(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches that windows in order cover together."""
    cut = np.flatnonzero(first[1:] > end[:-1]) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(first)]))):
        yield int(first[a]), int(end[b - 1])


def closest_windows(a: np.ndarray, lengths: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of the first ``lengths`` words of each row of ``a``, the one closest to the whole row of ``b``.

    Returns its edit distance, its first word and its words; of several the first one, and then the shortest.
    """
    n = b.shape[1]
    edit = a.shape[1] + 1
    kind = np.int32 if 2 * (n + 2) * edit < 1 << 31 else np.int64
    edit = kind(edit)  # a cost is edits * edit + the first word, so the least one has the first window
    ramp = np.arange(n + 1, dtype=kind) * edit
    row = np.tile(ramp, (len(a), 1))
    best, stop = row[:, n].copy(), np.zeros(len(a), dtype=np.int64)
    for j in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = j + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (a[:, j : j + 1] != b) * edit, row[:, 1:] + edit)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        closer = (row[:, n] < best) & (j < lengths)
        best[closer], stop[closer] = row[closer, n], j + 1
    begin = best % edit
    return best // edit, begin, np.maximum(stop - begin, 0)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            before = batch.column(2).to_pylist()
            best: list[dict[int, tuple]] = [{m["item"]: (m["distance"], m["first_word"], m["words"]) for m in found or ()} for found in before]
            for words in word_slices(batch.column(1), lower=True):
                for t, item, *rest in index.find(words):
                    own = best[words.first + t]
                    own[item] = min(own.get(item, tuple(rest)), tuple(rest))
            lists = [[{"item": i, "distance": d, "first_word": f, "words": w} for i, (d, f, w) in sorted(own.items())] for own in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, _TYPE)], names=["row", "text", "matches"])

    return run


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ("doc_id",), share: float = SHARE
) -> DataFrame:
    """``carry`` of each row of ``docs`` with ``matches``: every item that leaks into its text, by id.

    A match holds the item, the smallest distance, and the first window of that distance. A null or empty text
    matches nothing; items that are null, without words or without an id are left out; of items that share an
    id, the closest counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.withColumn("matches", F.expr(f"CAST(array() AS {MATCHES})"))
    wanted = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")

    def searched(df: DataFrame, block: list) -> DataFrame:
        index = Index([r["id"] for r in block], [r["text"] for r in block], share)
        return df.mapInArrow(_search(spark.sparkContext.broadcast(index)), f"row {kind}, text string, matches {MATCHES}")

    block = []
    for row in wanted.orderBy("id", "text").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_ITEMS:
            found, block = searched(found, block), []
    if block:
        found = searched(found, block)
    return found.select("row.*", "matches")
