"""Substring deduplication over difference-cover anchors.

A window is ``size`` consecutive words of one document. A word is removed when a window that covers it starts,
word for word, in a document with a smaller id. Windows are judged on the input.

1. Anchors: runs of ``size - period + 1`` words are hashed only where the position modulo ``period`` lies in a
   difference cover, a set of residues whose differences give every residue. Two equal windows at any two
   positions then have a common offset below ``period`` at which both positions are in the cover, so they share
   an anchor; 6 of 31 positions are hashed instead of all.
2. Anchors found in two documents mark where to look. Each such document extends its shared anchors to the
   windows around them, and only these windows are hashed.
3. The smallest id of each window decides; the others remove the words that it covers.

Documents with the same words are first put into one group, whose smallest id stands for it; the others go
whole, so a group of copies of any size costs one row a document. Counts combine before the shuffle; joins
have a plain table on each side, which lets AQE split hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import passing_tables, stored
from weirgate.llm.words import Words, chosen_runs, run_of, signed, word_slices

WINDOW = 50


def difference_cover(period: int) -> list[int]:
    """Residues below ``period`` whose differences are all residues, found greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gains = {c: {(c - a) % period for a in cover} | {(a - c) % period for a in cover} for c in range(1, period)}
        best = max(gains, key=lambda c: (len(gains[c] & missing), -c))
        cover.append(best)
        missing -= gains[best]
    return sorted(cover)


#: A perfect difference cover of 31: every residue is one difference of these.
COVER_31 = (0, 1, 3, 8, 12, 18)


def anchor_plan(size: int) -> tuple[np.ndarray, int]:
    """Which residues are hashed, and how many words an anchor has, for windows of ``size`` words."""
    period = min(31, max(1, size // 2))
    residues = np.zeros(period, dtype=bool)
    residues[list(COVER_31) if period == 31 else difference_cover(period)] = True
    return residues, size - period + 1


def _anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, first words and texts. Positions count from the text's start."""
    residues, length = anchor_plan(size)
    runs, starts, text = chosen_runs(words, length)
    at = residues[(starts - words.bounds[text]) % len(residues)]
    return runs[at], starts[at], text[at]


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(1)):
                n = len(words.bounds) - 1
                runs, _, text = _anchors(words, size)
                lists, at = [], np.searchsorted(text, np.arange(n + 1))
                for i in range(n):
                    lists.append(np.unique(signed(runs[at[i] : at[i + 1]])))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, n),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array([_digest(words, i) for i in range(n)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists), pa.int64())),
                    ],
                    names=["id", "n_words", "same", "anchors"],
                )

    return run


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The values of a list column by row."""
    flat, offsets, known = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_pylist()
    return [np.sort(flat[offsets[i] : offsets[i + 1]]) if known[i] else None for i in range(len(column))]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _extended(size: int):
    """Windows of a document that hold one of its shared anchors, once each."""
    _, length = anchor_plan(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, ids = _lists(batch.column(2)), batch.column(0).to_pylist()
            for words in word_slices(batch.column(1)):
                runs, starts, text = _anchors(words, size)
                windows, opened, owner = chosen_runs(words, size)
                first, last = np.searchsorted(owner, np.arange(len(words.bounds))), np.searchsorted(text, np.arange(len(words.bounds)))
                for i in range(len(words.bounds) - 1):
                    mine, at = windows[first[i] : first[i + 1]], slice(last[i], last[i + 1])
                    if not len(mine):
                        continue
                    hit = starts[at][_among(signed(runs[at]), shared[words.first + i])] - words.bounds[i]
                    # a window that starts at p holds the anchors that start from p to p + size - length
                    mark = np.zeros(len(mine) + 1, dtype=np.int64)
                    np.add.at(mark, np.clip(hit - (size - length), 0, len(mine)), 1)
                    np.add.at(mark, np.clip(hit + 1, 0, len(mine)), -1)
                    found = np.unique(signed(mine[np.cumsum(mark[:-1]) > 0]))
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found, pa.int64()), pa.array(np.full(len(found), ids[words.first + i]), pa.int64())], names=["w", "id"]
                        )

    return run


def _digest(words: Words, i: int) -> bytes:
    return xxhash.xxh3_128_digest(words.hashes[words.of(i)].tobytes())


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, removed, copies = batch.column(1).is_valid().to_pylist(), _lists(batch.column(2)), batch.column(3).to_pylist()
            for words in word_slices(batch.column(1)):
                n = len(words.bounds) - 1
                kept, gone = [], []
                for i in range(n):
                    row, at = words.first + i, words.of(i)
                    m, keep = at.stop - at.start, None
                    if copies[row] and _digest(words, i) in copies[row]:
                        keep = np.zeros(m, dtype=bool)
                    elif removed[row] is not None:
                        hit = np.flatnonzero(_among(signed(run_of(words.hashes[at], size)), removed[row]))
                        mark = np.zeros(m + 1, dtype=np.int64)
                        mark[hit] += 1
                        mark[hit + size] -= 1
                        keep = np.cumsum(mark[:-1]) == 0
                    kept.append(words.joined(i, keep) if known[row] else None)
                    gone.append(0 if keep is None else int(m - keep.sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, n),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["row", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the key, ``carry``, ``n_words``, ``n_removed`` and ``kept``.

    ``kept`` holds the words left, joined by one space; it is null for a null text and empty when nothing is
    left. Texts of fewer than ``size`` words lose nothing. The key is an integer. Rows that share a key are
    one document as far as "smaller" goes, so they never remove each other's words; a row without a key loses
    nothing and removes nothing. Other columns of ``docs`` are ignored.
    """
    if size < 2:
        raise ValueError("a window has two words at least")
    with passing_tables(docs.sparkSession) as keep:
        plan = keep(_plan(docs, key, text, size), "cuts")
    held = F.struct(F.col(key), *carry).alias("row")
    whole = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), held)
    kind = whole.schema["row"].dataType.simpleString()
    return (
        whole.join(plan, "id", "left")
        .select("row", "text", "removed", "copies")
        .mapInArrow(_cut(size), f"row {kind}, n_words long, n_removed long, kept string")
        .select("row.*", "n_words", "n_removed", "kept")
    )


def _plan(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The windows that go from each document (``removed``), and the texts of it that are copies of another's."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    profiles = stored(
        rows.where("id is not null and text is not null").mapInArrow(_profile(size), "id long, n_words long, same binary, anchors array<long>"), "anchors"
    ).where(F.col("n_words") >= size)
    groups = stored(profiles.groupBy("same").agg(F.min("id").alias("least")), "copies")
    grouped = profiles.join(groups, "same")
    copies = grouped.where("id > least").select("id", "same")
    firsts = stored(grouped.where("id = least").select("id", F.explode("anchors").alias("h")).distinct(), "firsts")
    shared = stored(firsts.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h"), "shared")
    marks = firsts.join(shared, "h").groupBy("id").agg(F.collect_set("h").alias("shared"))
    found = stored(
        rows.join(stored(marks, "marks"), "id").select("id", "text", "shared").mapInArrow(_extended(size), "w long, id long"), "windows"
    )
    least = stored(found.groupBy("w").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("w", "least"), "least")
    removed = found.join(least, "w").where("id > least").groupBy("id").agg(F.collect_set("w").alias("removed"))
    return copies.groupBy("id").agg(F.collect_set("same").alias("copies")).join(removed, "id", "full").select("id", "removed", "copies")
