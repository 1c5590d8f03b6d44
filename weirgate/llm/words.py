"""Words of whole texts as arrays of 64-bit hashes, computed over the UTF-8 bytes of a batch at once.

A word is a longest run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over random byte
values modulo 2^64, scrambled at the end; equal words have equal hashes everywhere, and unequal words are
taken to be equal with probability about 2^-64 per pair. Texts are taken in slices of bounded size cut at
separators, so memory does not depend on the length of a text beyond 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SEED = np.random.default_rng(20240501)
BYTE_VALUE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES + 1)
        _POWERS = np.full(size, BASE)
        _POWERS[0] = 1
        _POWERS = np.multiply.accumulate(_POWERS)
        _INVERSES = np.full(size, INVERSE)
        _INVERSES[0] = 1
        _INVERSES = np.multiply.accumulate(_INVERSES)
    return _POWERS, _INVERSES


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each ``values[start:end]``; equal runs have equal hashes wherever they are."""
    powers, inverses = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def run_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive values, by its start."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    parts, at = [], 0
    while at < n:  # in pieces, so that the powers stay small
        m = min(n - at, SLICE_BYTES - size)
        starts = np.arange(m)
        parts.append(run_hashes(hashes[at : at + m + size - 1], starts, starts + size))
        at += m
    return np.concatenate(parts)


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + len(bounds) - 2`` of a batch.

    ``hashes``, ``starts`` and ``ends`` (bytes from the start of ``data``) are by word; the words of the i-th text
    are ``bounds[i]`` to ``bounds[i + 1]``.
    """

    first: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.bounds[i], self.bounds[i + 1])

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The text's words joined by one space; only those where ``keep`` is true, if given."""
        at = self.of(i)
        starts, ends = self.starts[at], self.ends[at]
        if keep is not None:
            starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return b""
        sizes = ends - starts + 1  # each with its space
        offsets = np.cumsum(sizes)
        where = np.arange(offsets[-1]) + np.repeat(starts - np.concatenate(([0], offsets[:-1])), sizes)
        where[offsets - 1] = 0
        out = self.data[where]
        out[offsets - 1] = 0x20
        return out[:-1].tobytes()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def _slice_words(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``; no word goes across one of ``cuts``."""
    n = len(data)
    gap = IS_SEPARATOR[data]
    opens = ~gap
    closes = opens.copy()
    cuts = cuts[cuts < n]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[cuts] = True
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[cuts[cuts > 0] - 1] = True
    opens &= before
    closes &= after
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return run_hashes(BYTE_VALUE[LOWER_BYTE[data] if lower else data], starts, ends), starts, ends


def word_slices(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a batch of texts, some texts at a time; each text is whole in one item."""
    raw, offsets = _buffers(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        base, end = int(offsets[at]), int(offsets[stop])
        data, cuts = raw[base:end], offsets[at : stop + 1] - base
        if end - base <= SLICE_BYTES:
            hashes, starts, ends = _slice_words(data, cuts[:-1], lower) if end > base else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        else:  # one long text
            pieces, lo = [], 0
            while lo < len(data):
                hi = min(lo + SLICE_BYTES, len(data))
                while hi < len(data):  # back to the last separator, or on to the next one
                    back = np.flatnonzero(IS_SEPARATOR[data[lo:hi]])
                    if len(back) and back[-1]:
                        hi = lo + int(back[-1])
                        break
                    hi = min(hi + SLICE_BYTES, len(data))
                h, s, e = _slice_words(data[lo:hi], np.zeros(1, np.int64), lower)
                pieces.append((h, s + lo, e + lo))
                lo = hi
            hashes, starts, ends = (np.concatenate(x) for x in zip(*pieces))
        bounds = np.searchsorted(starts, cuts)
        yield Words(at, data, hashes, starts, ends, bounds)
        at = stop


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def chosen_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``size`` words inside one text: their hashes, first words, and texts (counted from ``first``)."""
    runs = run_of(words.hashes, size)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    starts = np.arange(len(runs))
    inside = words.bounds[text[: len(runs)] + 1] - starts >= size
    return runs[inside], starts[inside], text[: len(runs)][inside]


class HashIndex:
    """Numbers of 64-bit hashes in the order they were added, in an open-addressed table of arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys, self.entry = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, which is not 0; -1 where there is none."""
        mask = len(self.keys) - 1
        out = np.full(len(hashes), -1, np.int64)
        place, left = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            found = self.keys[place]
            hit = found == hashes[left]
            out[left[hit]] = self.entry[place[hit]]
            on = ~hit & (found != 0)
            left, place = left[on], (place[on] + 1) & mask
        return out

    def _put(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self.keys) - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[free]  # of several at one place the last one has it
            won = free & (self.keys[place] == hashes)
            self.entry[place[won]] = entries[won]
            hashes, entries, place = hashes[~won], entries[~won], (place[~won] + 1) & mask

    def number(self, hashes: np.ndarray) -> None:
        """Give new different hashes the next numbers."""
        total = self.n + len(hashes)
        if 2 * total > len(self.keys):
            old, old_entries = self.keys, self.entry
            size = 1 << int(4 * total).bit_length()
            self.keys, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int64)
            self._put(old[old != 0], old_entries[old != 0])
        self._put(hashes, np.arange(self.n, total))
        self.n = total


class Runs:
    """Arrays of one kind side by side, by number."""

    def __init__(self, kind):
        self.flat, self.starts, self.sizes, self.used, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used += len(flat)
        self.n += len(sizes)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers one after the other, and where each one ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)
        return self.flat[where], ends
