"""Packing of whole documents into sequences of a fixed capacity by minimum bin slack.

A document is its token ids and an end id. Whole sequences are cut off it first; what remains is shorter than the
capacity, and only the number of remainders of each length matters for packing: at most ``capacity`` counts for a
corpus of any size. From them the driver plans windows. The longest length left opens a window; a subset-sum
dynamic program over the multiset of lengths left, one bit for each reachable sum, finds the filling closest to
the capacity, and walking its bit sets backwards gives the count of each length in it. The filling is repeated as
often as the counts allow, so every step uses up a length and the plan is small whatever the number of documents.
Where no subset fills the window, one more remainder is cut to fill it and its other part goes back. What is left
at the end, less than one window, is cut into sequences that are powers of two, which need no padding.

Remainders of one length are numbered over the whole corpus: each task numbers its own, and a running sum over the
tasks' counts gives where each task starts. The plan says which numbers go to which sequences.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.common import held, stored
from weirgate.llm.words import BYTE_VALUE, SLICE_BYTES, HashIndex, Runs, run_hashes
from weirgate.llm.words import _buffers as buffers

CAPACITY = 2048
SLICE_ROWS = 256
MAX_UNITS = 1_000_000
LONG_UNIT = 64
PIECE = "array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint,ids:binary>>"


# ---- the plan ----


@dataclass
class Run:
    """Remainders ``first`` to ``stop - 1`` of those that were ``origin`` long, without their first ``start`` ids."""

    origin: int
    first: int
    stop: int
    start: int


@dataclass
class Move:
    """A run put in place: its k-th part goes to sequence ``base + (at + k) // each``, of ``each`` such parts in one."""

    run: Run
    length: int
    base: int
    at: int
    each: int
    offset: int


def closest_filling(lengths: list[int], counts: list[int], target: int) -> dict[int, int]:
    """How many of each length add up to the largest sum of at most ``target``.

    ``lengths`` are in descending order; where several fillings reach the sum, longer lengths are preferred.
    """
    mask = (1 << (target + 1)) - 1
    reach, before = 1, []
    for length, count in zip(lengths, counts):
        before.append(reach)
        left, step = min(count, target // length), 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for i in range(len(before) - 1, -1, -1):
        n = 0
        while not before[i] >> total & 1:
            total -= lengths[i]
            n += 1
        if n:
            used[lengths[i]] = n
    return used


class Planner:
    """Windows for a multiset of lengths; see the module's docstring."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.pool: dict[int, list[Run]] = {n: [Run(n, 0, c, 0)] for n, c in counts.items() if c > 0}
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.moves: list[Move] = []
        self.sequences = 0

    def take(self, length: int, n: int) -> list[Run]:
        """``n`` parts of a length out of the pool."""
        runs, out = self.pool[length], []
        self.left[length] -= n
        while n:
            run = runs[-1]
            size = run.stop - run.first
            if size <= n:
                out.append(runs.pop())
                n -= size
            else:
                out.append(Run(run.origin, run.first, run.first + n, run.start))
                run.first += n
                n = 0
        if not self.left[length]:
            del self.pool[length], self.left[length]
        return out

    def put_back(self, length: int, runs: list[Run]) -> None:
        self.pool.setdefault(length, []).extend(runs)
        self.left[length] = self.left.get(length, 0) + sum(r.stop - r.first for r in runs)

    def place(self, runs: list[Run], length: int, each: int, offset: int) -> None:
        at = 0
        for run in runs:
            self.moves.append(Move(run, length, self.sequences, at, each, offset))
            at += run.stop - run.first

    def window(self) -> None:
        """The filling around the longest length, as often as there are lengths for it."""
        longest = max(self.left)
        lengths = sorted((n for n in self.left if n <= self.capacity - longest), reverse=True)
        free = [self.left[n] - (n == longest) for n in lengths]
        used = closest_filling(lengths, free, self.capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = self.capacity - sum(n * c for n, c in used.items())
        cut = 0
        if slack:
            # the filling is closest to the capacity, so whatever else is left is longer than the slack
            others = [n for n in self.left if self.left[n] > used.get(n, 0)]
            if not others:
                self.tail()
                return
            cut = max(others)
        needed = dict(used)
        if cut:
            needed[cut] = needed.get(cut, 0) + 1
        times = min(self.left[n] // c for n, c in needed.items())
        offset = 0
        for n in sorted(used, reverse=True):
            self.place(self.take(n, times * used[n]), n, used[n], offset)
            offset += n * used[n]
        if cut:
            runs = self.take(cut, times)
            self.place(runs, slack, 1, offset)
            self.put_back(cut - slack, [Run(r.origin, r.first, r.stop, r.start + slack) for r in runs])
        self.sequences += times

    def tail(self) -> None:
        """All that is left, less than a window, in sequences of descending powers of two."""
        parts = [
            (n, Run(r.origin, i, i + 1, r.start)) for n in sorted(self.pool, reverse=True) for r in self.pool[n] for i in range(r.first, r.stop)
        ]
        total = sum(n for n, _ in parts)
        room, offset = 1 << (total.bit_length() - 1), 0
        while parts:
            n, run = parts.pop(0)
            taken = min(n, room - offset)
            self.place([run], taken, 1, offset)
            if taken < n:
                parts.insert(0, (n - taken, Run(run.origin, run.first, run.stop, run.start + taken)))
            offset += taken
            total -= taken
            if offset == room:
                self.sequences += 1
                room, offset = 1 << max(total.bit_length() - 1, 0), 0
        self.pool, self.left = {}, {}

    def run(self) -> list[Move]:
        whole = self.left.get(self.capacity, 0)
        if whole:
            self.place(self.take(self.capacity, whole), self.capacity, 1, 0)
            self.sequences += whole
        while self.left:
            self.window()
        return self.moves


def plan_windows(counts: dict[int, int], capacity: int) -> list[Move]:
    """Where every part of every length goes. ``counts`` maps lengths of 1 to ``capacity`` to how many there are."""
    return Planner(counts, capacity).run()


class Places:
    """Looks up the pieces of a numbered remainder in a plan."""

    def __init__(self, moves: list[Move]):
        by_origin: dict[int, list[Move]] = {}
        for m in moves:
            by_origin.setdefault(m.run.origin, []).append(m)
        self.bounds: dict[int, list[int]] = {}
        self.found: dict[int, list[list[Move]]] = {}
        for origin, own in by_origin.items():
            bounds = sorted({b for m in own for b in (m.run.first, m.run.stop)})
            at = {b: i for i, b in enumerate(bounds)}
            found: list[list[Move]] = [[] for _ in bounds]
            for m in sorted(own, key=lambda m: m.run.start):
                for i in range(at[m.run.first], at[m.run.stop]):
                    found[i].append(m)
            self.bounds[origin], self.found[origin] = bounds, found

    def of(self, origin: int, number: int) -> Iterator[tuple[int, int, int, int]]:
        """Start in the remainder, length, sequence and offset of each piece, in order of start."""
        for m in self.found[origin][bisect_right(self.bounds[origin], number) - 1]:
            k = m.at + number - m.run.first
            yield m.run.start, m.length, m.base + k // m.each, m.offset + k % m.each * m.length


# ---- token ids ----


class Known:
    """Ids of units by their 64-bit hash; emptied when it is full."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index, self.ids = HashIndex(), Runs(np.uint32)

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New different hashes with their ids."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids.add(np.fromiter((i for each in ids for i in each), np.uint32, int(sizes.sum())), sizes)
        self.index.number(hashes)


SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
CLASSES[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASSES[0x30:0x3A] = DIGIT
CLASSES[[b for b in range(0x21, 0x7F) if CLASSES[b] == OTHER and b != 0x27]] = MARK  # all but the apostrophe

#: The normalizer and split under which runs of letters, digits and runs of marks are encoded apart.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordIds:
    """Ids of texts by a tokenizer file that splits at white space and drops it.

    Where the file has the expected normalizer and split, a word of the letters of Latin-1, digits and ASCII marks
    is cut into lower-case units: runs of letters, digits, runs of marks. Other words, with an apostrophe or other
    characters in them, are units as they are, and so are all words with other files. A unit is looked up by its
    hash and goes to the library once a worker, up to a bound; unequal units are taken to be equal with
    probability about 2^-64 a pair. Units of more than ``LONG_UNIT`` bytes are not kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", ())]
        #: Words are apart from each other only where white space is dropped and no special token holds any.
        self.splits = spec["model"].get("end_of_word_suffix") is not None and not any(
            re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())
        )
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fine = (
            (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and len(before) == 2
            and before[0].get("pattern", {}).get("Regex") == SPLIT
            and before[0].get("invert")
            and before[1].get("type") == "ByteLevel"
            and not before[1].get("use_regex", True)
            and not before[1].get("add_prefix_space")
        )
        self.classes = CLASSES.copy()
        self.classes[[t.encode()[0] for t in special if t]] = OTHER
        if not self.fine:
            self.classes[CLASSES != SPACE] = OTHER
        #: The merges alone, for units that need no more normalizing or splitting.
        self.merges = Tokenizer(self.tokenizer.model)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.known = Known(MAX_UNITS)

    def _encoded(self, units: list[bytes], simple: np.ndarray) -> list[list[int]]:
        own = [u.decode("latin-1").translate(self.letters) for u, s in zip(units, simple) if s]
        raw = [u.decode() for u, s in zip(units, simple) if not s]
        by_merges = iter(self.merges.encode_batch_fast(own, add_special_tokens=False))
        by_file = iter(self.tokenizer.encode_batch_fast(raw, add_special_tokens=False))
        return [next(by_merges if s else by_file).ids for s in simple]

    def units(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and simplicity of the units of some bytes, and the bytes in lower case where that is due."""
        kinds = self.classes[data]
        values = data.copy()
        if self.fine:
            # C3 and what follows it: the letters of Latin-1, but for the signs of multiplication and division
            after = np.zeros(len(data), bool)
            after[1:] = data[:-1] == 0xC3
            letter = after & (data != 0x97) & (data != 0xB7)
            kinds[letter] = LETTER
            kinds[:-1][letter[1:]] = LETTER
            upper = (letter & (data >= 0x80) & (data <= 0x9E)) | ((data >= 0x41) & (data <= 0x5A))
            values[upper] += 0x20
        full = kinds != SPACE
        opens = full.copy()
        opens[1:] &= ~full[:-1]
        opens[cuts] = full[cuts]
        words = np.flatnonzero(opens)
        if not len(words):
            return words, words, np.zeros(0, bool), values
        plain = np.maximum.reduceat(kinds, words) != OTHER  # what lies between words is 0
        sizes = np.diff(np.append(words, len(data)))
        simple = np.zeros(len(data), bool)
        simple[words[0] :] = np.repeat(plain, sizes)
        values = np.where(simple, values, data)
        opens[1:] |= full[1:] & simple[1:] & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT))
        closes = full.copy()
        closes[:-1] &= ~full[1:] | opens[1:]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, simple[starts], values

    def some(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``offsets``, one after the other, and how many ids each text has."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        starts, ends, simple, values = self.units(data, offsets[:-1][offsets[:-1] < len(data)])
        hashes = run_hashes(BYTE_VALUE[values], starts, ends)
        hashes[hashes == 0] = 1
        known, long = self.known, np.flatnonzero(ends - starts > LONG_UNIT)
        entries = known.index.find(hashes)
        entries[long] = -2
        new = np.flatnonzero(entries == -1)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            if known.index.n + len(fresh) > known.most:
                known.clear()
                new = np.flatnonzero(entries != -2)
                fresh, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            raw = values.tobytes()
            known.add(fresh, self._encoded([raw[s:e] for s, e in zip(starts[at], ends[at])], simple[at]))
            entries[new] = known.index.find(hashes[new])
        runs = known.ids
        sizes, begin, flat = runs.sizes[entries], runs.starts[entries], runs.flat
        if len(long):
            raw = values.tobytes()
            ids = self._encoded([raw[s:e] for s, e in zip(starts[long], ends[long])], simple[long])
            sizes[long] = [len(x) for x in ids]
            begin[long] = runs.used + np.cumsum(sizes[long]) - sizes[long]
            flat = np.concatenate((runs.flat[: runs.used], *[np.array(x, np.uint32) for x in ids]))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        where = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], sizes)
        return flat[where].astype(self.kind), np.diff(bounds[np.searchsorted(starts, offsets)])

    def encoded(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, each followed by the end id, one after the other; and the offsets of the texts in them."""
        raw, offsets = buffers(texts)
        n, at, parts = len(offsets) - 1, 0, []
        while at < n:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            data, own = raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
            if not self.splits:
                found = self.tokenizer.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(own, own[1:])], add_special_tokens=False)
                parts.append((np.array([i for x in found for i in x.ids], self.kind), np.array([len(x.ids) for x in found], np.int64)))
            elif len(data) <= SLICE_BYTES:
                parts.append(self.some(data, own))
            else:
                slices = [self.some(data[a:b], np.array([0, b - a])) for a, b in _slices(data)]
                parts.append((np.concatenate([ids for ids, _ in slices]), sum(sizes for _, sizes in slices)))
            at = stop
        sizes = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        ids = np.full(int(bounds[-1]), end_id, self.kind)
        inside = np.ones(len(ids), bool)
        inside[bounds[1:] - 1] = False
        ids[inside] = np.concatenate([i for i, _ in parts]) if parts else []
        return ids, bounds


def _slices(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about ``SLICE_BYTES`` of one long text, cut at white space only."""
    at = 0
    while at < len(data):
        stop = min(at + SLICE_BYTES, len(data))
        while stop < len(data):  # back to the last white space, or on to the next
            gaps = np.flatnonzero(CLASSES[data[at:stop]] == SPACE)
            if len(gaps) and gaps[-1]:
                stop = at + int(gaps[-1])
                break
            stop = min(stop + SLICE_BYTES, len(data))
        yield at, stop
        at = stop


def load(path: str) -> WordIds:
    return held((WordIds, path), lambda: WordIds(path))


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of an array as binary values, without a copy."""
    offsets = pa.py_buffer((bounds * values.dtype.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def numbered(kinds: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many equal kinds came before each, ``seen`` included, which is brought up to date."""
    order = np.argsort(kinds, kind="stable")
    ordered = kinds[order]
    first = np.searchsorted(ordered, ordered)
    out = np.empty(len(kinds), np.int64)
    out[order] = np.arange(len(kinds)) - first + seen[ordered]
    seen += np.bincount(kinds, minlength=len(seen))
    return out


def _encode(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        chunk, whole_seen, rest_seen = TaskContext.get().partitionId(), 0, np.zeros(capacity, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids, bounds = words.encoded(part.column(1), end_id)
                sizes = np.diff(bounds)
                whole, rest = sizes // capacity, sizes % capacity
                before = np.cumsum(whole) - whole + whole_seen
                whole_seen += int(whole.sum())
                numbers = (np.full(len(sizes), chunk, np.int32), sizes, whole, before, rest.astype(np.int32), numbered(rest, rest_seen))
                columns = [pa.array(x) for x in numbers]
                names = ["row", "packed", "chunk", "doc_tokens", "whole", "whole_nth", "rest", "rest_nth"]
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(ids, bounds), *columns], names=names)

    return run


def _place(path: str, capacity: int, moves):
    """Rows (row, packed, chunk, whole, whole_nth, rest, rest_nth, starts) to (row, doc_tokens, pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, places = load(path).kind, Places(moves.value)
        starts: dict[int, dict[int, int]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                ids = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).astype("<u4")
                chunks, whole, whole_nth, rest, rest_nth = (part.column(i).to_pylist() for i in range(2, 7))
                found: list[tuple[int, int, int, int]] = []
                bounds = [0]
                for i, chunk in enumerate(chunks):
                    if chunk not in starts:
                        starts.clear()
                        starts[chunk] = {x["length"]: x["first"] for x in part.column(7)[i].as_py()}
                    first, end = starts[chunk], whole[i] * capacity
                    for k in range(whole[i]):
                        found += [(k * capacity, *p[1:]) for p in places.of(capacity, first[capacity] + whole_nth[i] + k)]
                    if rest[i]:
                        found += [(end + p[0], *p[1:]) for p in places.of(rest[i], first[rest[i]] + rest_nth[i])]
                    bounds.append(len(found))
                # the pieces of a document follow each other, so their ids are the document's, cut
                numbers = np.array(found, np.int64).reshape(-1, 4).T
                cuts = np.concatenate(([0], np.cumsum(numbers[1])))
                pieces = pa.StructArray.from_arrays(
                    [*(pa.array(x) for x in numbers), _binary(ids, cuts)], names=["start", "length", "sequence_id", "offset", "ids"]
                )
                tokens = np.diff(cuts[bounds])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), lists], names=["row", "doc_tokens", "pieces"])

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row a piece: ``carry``, ``start``, ``length``, ``sequence_id``, ``offset``, ``ids`` and ``doc_tokens``.

    ``start`` counts the ids of the document before the piece, ``offset`` those of the sequence; ``ids`` are
    little-endian unsigned 32-bit integers. Sequences are full, but for at most eleven at the end that are powers
    of two. A null or empty text is the end id alone. Rows are packed by themselves, so repeated or null ids
    and repeated texts have pieces of their own. Without rows there are no pieces.

    The rows' ids are written once. ``starts``, where each task's numbering begins, has one row a task; Spark
    broadcasts it while it is small and joins it by task otherwise. The plan that is broadcast depends on the
    capacity and not on the number of rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    numbers = "chunk int, doc_tokens long, whole long, whole_nth long, rest int, rest_nth long"
    encoded = stored(rows.mapInArrow(_encode(path, capacity, end_id), f"row {kind}, packed binary, {numbers}"), "packed")
    rests = encoded.where("rest > 0").groupBy("chunk", F.col("rest").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    wholes = encoded.groupBy("chunk").agg(F.sum("whole").alias("n")).select("chunk", F.lit(capacity).alias("length"), "n")
    tallies = stored(rests.unionByName(wholes), "tallies")
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    moves = spark.sparkContext.broadcast(plan_windows(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = tallies.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    starts = stored(first.groupBy("chunk").agg(F.collect_list(F.struct("length", "first")).alias("starts")), "starts")
    placed = encoded.join(starts, "chunk").select("row", "packed", "chunk", "whole", "whole_nth", "rest", "rest_nth", "starts")
    pieces = placed.mapInArrow(_place(path, capacity, moves), f"row {kind}, doc_tokens long, pieces {PIECE}")
    return pieces.select("row.*", "doc_tokens", F.inline("pieces")).select(
        *carry, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"
    )
