"""Alignment of two tokenizers over whole documents, by an associative fragment of a byte range.

Tokenizer A encodes a space and the text, tokenizer B the text before which it puts a space itself, so the bytes of
both are the same. Where tokens of both end at one byte, a group ends. The tokens that end inside a byte range make
a fragment: an open head up to the first common end, closed groups, and an open tail after the last one. Two
neighbouring fragments compose by closing the left tail with the right head; that is associative, so the fragments
of a very long document are made by different tasks and composed in a tree. Its byte ranges cut words and tokens
wherever they fall; only encoding needs places where both tokenizers always split, before white space.

Shorter documents are cut at those places within a task, and each different part is encoded and aligned once a
worker, up to a bound; parts are told apart by 64-bit hashes. The corpus-wide count of a pair of ids is summed over blocks of documents, each with a list
of its different pairs, so that what is shuffled are pairs of blocks and not links of documents.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import held, stored
from weirgate.llm.tokencount import AFTER_LETTERS, safe_parts
from weirgate.llm.words import BYTE_VALUE, SLICE_BYTES, HashIndex, Runs, run_hashes

CHUNK_BYTES = 1 << 16
FAN = 8
SLICE_ROWS = 64
MAX_PARTS = 400_000
MAX_BYTES = 1 << 25
BLOCK_PAIRS = 1 << 19
WORD = re.compile(r" [A-Za-z]+")
SAFE_CUT = re.compile(r"(?<=[^\W_])(?=[ \n])")


# ---- fragments ----


@dataclass
class Closed:
    """Closed groups: their text, token and group counts, and the links of their tokens by pair of ids."""

    groups: list[str] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    links: dict[int, int] = field(default_factory=dict)

    def __add__(self, other: Closed) -> Closed:
        few, many = sorted((self.links, other.links), key=len)
        links = dict(many)
        for pair, n in few.items():
            links[pair] = links.get(pair, 0) + n
        return Closed(self.groups + other.groups, self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, links)


@dataclass
class Fragment:
    """Tokens as (id, bytes) pairs that end in a byte range. Without a common end all of them are in the heads."""

    head_a: list[tuple[int, int]] = field(default_factory=list)
    head_b: list[tuple[int, int]] = field(default_factory=list)
    closes: bool = False
    closed: Closed = field(default_factory=Closed)
    tail_a: list[tuple[int, int]] = field(default_factory=list)
    tail_b: list[tuple[int, int]] = field(default_factory=list)
    same: bool = True

    def then(self, right: Fragment) -> Fragment:
        """This range followed by the next one."""
        same = self.same and right.same
        if not self.closes:
            heads = self.head_a + right.head_a, self.head_b + right.head_b
            return Fragment(*heads, right.closes, right.closed, right.tail_a, right.tail_b, same)
        tails = self.tail_a + right.head_a, self.tail_b + right.head_b
        if not right.closes:
            return Fragment(self.head_a, self.head_b, True, self.closed, *tails, same)
        joint = align(*tails) if same else Closed()
        return Fragment(self.head_a, self.head_b, True, self.closed + joint + right.closed, right.tail_a, right.tail_b, same)


#: What stands before a document: a common end, and nothing else.
START = Fragment(closes=True)


def align(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> Closed:
    """Groups and links of two runs of tokens over the same bytes."""
    groups, links, n_a, n_b = [], {}, len(a), len(b)
    i = j = first_a = first_b = 0
    end_a, end_b = (a[0][1], b[0][1]) if a and b else (0, 0)
    while i < n_a and j < n_b:
        pair = a[i][0] << 32 | b[j][0]
        links[pair] = links.get(pair, 0) + 1
        order = end_a - end_b
        if order <= 0:
            i += 1
            if i < n_a:
                end_a += a[i][1]
        if order >= 0:
            j += 1
            if j < n_b:
                end_b += b[j][1]
        if order == 0:
            left = ",".join([str(t) for t, _ in a[first_a:i]])
            groups.append(left + "|" + ",".join([str(t) for t, _ in b[first_b:j]]))
            first_a, first_b = i, j
    return Closed(groups, n_a, n_b, len(groups), links)


def fragment(a: list[tuple[int, int]], b: list[tuple[int, int]], ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of the tokens of a byte range, with the bytes at which they end."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return Fragment(a, b)
    a1, a2 = np.searchsorted(ends_a, common[[0, -1]], side="right")
    b1, b2 = np.searchsorted(ends_b, common[[0, -1]], side="right")
    return Fragment(a[:a1], b[:b1], True, align(a[a1:a2], b[b1:b2]), a[a2:], b[b2:])


def fragments(a: list[tuple[int, int]], b: list[tuple[int, int]], start: int, size: int) -> Iterator[tuple[int, Fragment]]:
    """The fragments of tokens that begin at byte ``start``, by the ranges of ``size`` bytes they end in."""
    ends_a = start + np.cumsum([n for _, n in a], dtype=np.int64)
    ends_b = start + np.cumsum([n for _, n in b], dtype=np.int64)
    last = max(ends_a[-1] if len(a) else start, ends_b[-1] if len(b) else start)
    for line in range(start // size, -(-int(last) // size)):
        a1, a2 = np.searchsorted(ends_a, [line * size, (line + 1) * size], side="right")
        b1, b2 = np.searchsorted(ends_b, [line * size, (line + 1) * size], side="right")
        yield max(start, line * size), fragment(a[a1:a2], b[b1:b2], ends_a[a1:a2], ends_b[b1:b2])


# ---- tokenizers ----


def parts_of(text: str) -> list[str]:
    """Parts cut where both tokenizers always split; B joins a carriage return to what is before it."""
    return AFTER_LETTERS.split(text) if "\r" in text else safe_parts(text)


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Entries:
    """The bytes of a vocabulary's entries, side by side by id; an id without any stands for no bytes."""

    def __init__(self, texts: dict[int, bytes]):
        n = max(texts) + 1
        self.sizes = np.zeros(n, np.int64)
        for i, t in texts.items():
            self.sizes[i] = len(t)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts.get(i, b"") for i in range(n)), np.uint8)
        # each id as decimal digits with room for a separator
        numbers = [b"%d," % i for i in range(n)]
        self.digit_sizes = np.array([len(t) for t in numbers])
        self.digit_starts = np.cumsum(self.digit_sizes) - self.digit_sizes
        self.digits = np.frombuffer(b"".join(numbers), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.starts[ids], self.sizes[ids])


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A]] = True
#: Bytes that may belong to other white space, by the byte before them (0 for any).
ODD = np.zeros(256, bool)
ODD[[0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
ODD_PAIRS = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def part_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of parts of the texts between ``bounds``, as :func:`parts_of` has them or fewer.

    A text with other white space than spaces, tabs and line ends is cut after ASCII letters and digits only.
    """
    white = WHITE[data]
    cut = white.copy()
    cut[1:] &= ~white[:-1]
    odd = ODD[data]
    for first, second in ODD_PAIRS:
        odd[1:] |= (data[:-1] == first) & (data[1:] == second)
    if odd.any():
        texts = np.unique(np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1)
        for i in texts:
            own = slice(bounds[i], bounds[i + 1])
            part = data[own]
            after = np.zeros(len(part), bool)
            after[1:] = ALNUM[part[:-1]] & ((part[1:] == 0x20) | (part[1:] == 0x0A))
            cut[own] = after
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(cut)


class Pair:
    """Two tokenizer files: byte-level ``.json`` (A) and sentencepiece ``.model`` (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("tokenizer A has to be byte-level, with its usual split and without a normalizer")
        #: The merges alone, for a space and ASCII letters, which the split leaves whole.
        self.merges = Tokenizer(self.a.model)
        letters = _byte_level()
        self.entries_a = Entries({i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        texts = {
            i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(names)
            if not self.b.is_control(i) and not self.b.is_unknown(i)
        }
        self.entries_b = Entries(texts)
        usual = [p for i, p in enumerate(names) if i in texts and not self.b.is_byte(i)]
        #: What is put before a part: B's space goes before it, and nothing joins over a line end.
        self.lead = self.b.encode("\n")
        if any("▁" in p.lstrip("▁") or set(p) & set("\t\n") for p in usual) or len(self.lead) != 2:
            raise ValueError("tokenizer B needs spaces at the start of pieces only and single bytes for tabs and line ends")
        self.clear()

    def clear(self) -> None:
        self.index, self.texts, self.links = HashIndex(), Runs(np.uint8), Runs(np.int64)
        self.counts = np.zeros((MAX_PARTS, 3), np.int32)  # tokens of A and B and groups; -1 where bytes differ
        self.hashes, self.uses = np.zeros(MAX_PARTS, np.uint64), np.zeros(MAX_PARTS, np.int32)

    def shrink(self, room: int) -> None:
        """Keep the parts that were used most, up to half of the bounds, so that ``room`` more fit."""
        n, least = self.index.n, 2
        while True:
            kept = np.flatnonzero(self.uses[:n] >= least)
            if 2 * len(kept) <= MAX_PARTS and 2 * int(self.texts.sizes[kept].sum()) <= MAX_BYTES and len(kept) + room <= MAX_PARTS:
                break
            least *= 2
        texts, links, counts, hashes = self.texts, self.links, self.counts[kept], self.hashes[kept]
        self.clear()
        for runs, old in ((self.texts, texts), (self.links, links)):
            runs.add(old.of(kept)[0], old.sizes[kept])
        self.counts[: len(kept)], self.hashes[: len(kept)] = counts, hashes
        self.index.number(hashes)

    def tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of parts, one after the other, how many each part has, and whether its bytes are the part's."""
        words = [WORD.fullmatch(p) is not None for p in parts]
        by_merges = iter(self.merges.encode_batch_fast(["Ġ" + p[1:] for p, w in zip(parts, words) if w], add_special_tokens=False))
        by_file = iter(self.a.encode_batch_fast([p for p, w in zip(parts, words) if not w], add_special_tokens=False))
        found_a = [next(by_merges if w else by_file).ids for w in words]
        found_b = self.b.encode(["\n" + p for p in parts], num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (found_a, found_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (found_a, found_b))
        led = np.ones(len(b), bool)
        heads = np.cumsum(n_b) - n_b
        for k in range(len(self.lead)):
            led[heads + k] = False
        b, n_b = b[led], n_b - len(self.lead)
        raw = [p.encode() for p in parts]
        sizes, joined = np.fromiter(map(len, raw), np.int64, len(raw)), np.frombuffer(b"".join(raw), np.uint8)
        same = np.ones(len(parts), bool)
        for ids, n, entries in ((a, n_a, self.entries_a), (b, n_b, self.entries_b)):
            owner = np.repeat(np.arange(len(parts)), n)
            same &= np.bincount(owner, weights=entries.sizes[ids], minlength=len(parts)).astype(np.int64) == sizes
            kept = same[owner]
            differ = entries.bytes_of(ids[kept]) != joined[np.repeat(same, sizes)]
            wrong = np.repeat(np.arange(len(parts)), sizes)[np.repeat(same, sizes)][differ]
            same[wrong] = False
        return a, b, n_a, n_b, same

    def learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Align new parts, all at once: the bytes of one follow those of the other."""
        a, b, n_a, n_b, same = self.tokens(parts)
        a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
        n_a, n_b = np.where(same, n_a, 0), np.where(same, n_b, 0)
        ends_a, ends_b = np.cumsum(self.entries_a.sizes[a]), np.cumsum(self.entries_b.sizes[b])
        # two tokens overlap in one stretch between neighbouring ends of either side
        both = np.concatenate((ends_a, ends_b))
        both.sort(kind="stable")
        again = both[1:] == both[:-1]
        stretches, common = both[np.append(True, ~again)] if len(both) else both, both[1:][again]
        pairs = a[np.searchsorted(ends_a, stretches)] << 32 | b[np.searchsorted(ends_b, stretches)]
        last = np.concatenate(([0], ends_a))[np.cumsum(n_a)]  # where each part ends
        text, sizes = self._written(a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common))
        group_ends = np.cumsum(sizes)
        n_groups = np.diff(np.searchsorted(common, last, side="right"), prepend=0)
        self.texts.add(text, np.diff(np.concatenate(([0], group_ends))[np.cumsum(n_groups)], prepend=0))
        self.links.add(pairs, np.diff(np.searchsorted(stretches, last, side="right"), prepend=0))
        counts = np.stack((n_a, n_b, n_groups), axis=1)
        counts[~same] = -1
        own = slice(self.index.n, self.index.n + len(parts))
        self.counts[own], self.hashes[own] = counts, hashes
        self.index.number(hashes)

    def _written(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups as text, a semicolon after each, and the bytes of each; tokens are given with their groups."""
        of_a, of_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
        base = np.cumsum(of_a + of_b) - of_a - of_b
        place_a = base[in_a] + np.arange(len(a)) - (np.cumsum(of_a) - of_a)[in_a]
        place_b = (base + of_a)[in_b] + np.arange(len(b)) - (np.cumsum(of_b) - of_b)[in_b]
        total = len(a) + len(b)
        starts, sizes, separators = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
        offset = len(self.entries_a.digits)
        starts[place_a], sizes[place_a] = self.entries_a.digit_starts[a], self.entries_a.digit_sizes[a]
        starts[place_b], sizes[place_b] = offset + self.entries_b.digit_starts[b], self.entries_b.digit_sizes[b]
        separators[base + of_a - 1], separators[base + of_a + of_b - 1] = ord("|"), ord(";")
        text = _gathered(np.concatenate((self.entries_a.digits, self.entries_b.digits)), starts, sizes)
        ends = np.cumsum(sizes)
        text[ends - 1] = separators
        return text, np.diff(np.concatenate(([0], ends))[np.cumsum(of_a + of_b)], prepend=0)

    def documents(self, texts: list[str]) -> list[tuple[bytes, int, int, int, np.ndarray, np.ndarray]]:
        """Groups, counts, pairs of ids and their links of whole texts."""
        raw = [(" " + t).encode() if t else b"" for t in texts]
        out, at = [], 0
        while at < len(raw):
            stop, size = at + 1, len(raw[at])
            while stop < len(raw) and size + len(raw[stop]) <= SLICE_BYTES:
                size += len(raw[stop])
                stop += 1
            out += self._documents(raw[at:stop])
            at = stop
        return out

    def _documents(self, raw: list[bytes]) -> list[tuple[bytes, int, int, int, np.ndarray, np.ndarray]]:
        joined = b"".join(raw)
        if not joined:
            return [NOTHING] * len(raw)
        data, bounds = np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        starts = part_starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes = run_hashes(BYTE_VALUE[data], starts, ends)
        hashes[hashes == 0] = 1
        entries = self.index.find(hashes)
        new = np.flatnonzero(entries < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            if self.index.n + len(fresh) > MAX_PARTS or self.texts.used > MAX_BYTES:
                self.shrink(len(np.unique(hashes)))
                entries = self.index.find(hashes)
                new = np.flatnonzero(entries < 0)
                fresh, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            self.learn(fresh, [joined[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            entries[new] = self.index.find(hashes[new])
        used, times = np.unique(entries, return_counts=True)
        self.uses[used] += times.astype(np.int32)
        text, text_ends = self.texts.of(entries)
        links, link_ends = self.links.of(entries)
        counts = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(self.counts[entries], axis=0)))
        broken = np.concatenate(([0], np.cumsum(self.counts[entries, 0] < 0)))
        cuts = np.searchsorted(starts, bounds)
        text_cuts, link_cuts = (np.concatenate(([0], x))[cuts] for x in (text_ends, link_ends))
        text, out = text.tobytes(), []
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo == hi or broken[hi] > broken[lo]:
                out.append(NOTHING)
                continue
            pairs, n = np.unique(links[link_cuts[i] : link_cuts[i + 1]], return_counts=True)
            out.append((text[text_cuts[i] : text_cuts[i + 1] - 1], *(counts[hi] - counts[lo]).tolist(), pairs, n))
        return out


NOTHING = (b"", 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64))
def load(path_a: str, path_b: str) -> Pair:
    return held((Pair, path_a, path_b), lambda: Pair(path_a, path_b))


# ---- tables ----

RESULT = "groups string, n_a long, n_b long, n_groups long, pairs array<long>, pair_links array<long>"
PIECES = "array<struct<id:int,size:int>>"
PARTIAL = f"head_a {PIECES}, head_b {PIECES}, closes boolean, {RESULT}, tail_a {PIECES}, tail_b {PIECES}, same boolean"


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _results(rows: list[tuple]) -> list[pa.Array]:
    groups, n_a, n_b, n_groups, pairs, links = zip(*rows) if rows else [()] * 6
    numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
    return [pa.array(groups, pa.binary()).cast(pa.string()), *numbers, _lists(list(pairs)), _lists(list(links))]


RESULT_NAMES = ["groups", "n_a", "n_b", "n_groups", "pairs", "pair_links"]


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = both.documents([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *_results(found)], names=["row", *RESULT_NAMES])

    return run


def spans(text: str, size: int) -> Iterator[tuple[int, str]]:
    """A space and the text in parts of about ``size`` characters, cut where both tokenizers split, with their bytes' start."""
    text, at, start = " " + text, 0, 0
    while at < len(text):
        stop = len(text)
        if stop - at > size:
            back = list(SAFE_CUT.finditer(text, at + size // 2, at + size))
            cut = back[-1] if back else SAFE_CUT.search(text, at + size)
            stop = cut.start() if cut else stop
        span = text[at:stop]
        yield start, span
        at, start = stop, start + len(span.encode())


def _spans(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(spans(batch.column(2)[i].as_py(), size))
                first = pa.array([i] + [None] * (len(found) - 1), pa.int64())  # the row goes with the first span only
                key = pa.array([batch.column(0)[i].as_py()] * len(found), pa.int64())
                starts, texts = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [key, batch.column(1).take(first), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names=["key", "row", "start", "span"]
                )

    return run


def _stored_fragment(f: Fragment) -> dict:
    c = f.closed
    tokens = {name: [{"id": i, "size": n} for i, n in getattr(f, name)] for name in ("head_a", "head_b", "tail_a", "tail_b")}
    return tokens | {
        "closes": f.closes,
        "same": f.same,
        "groups": ";".join(c.groups),
        "n_a": c.n_a,
        "n_b": c.n_b,
        "n_groups": c.n_groups,
        "pairs": list(c.links),
        "pair_links": list(c.links.values()),
    }


def _read_fragment(row: dict) -> Fragment:
    tokens = [[(t["id"], t["size"]) for t in row[name]] for name in ("head_a", "head_b", "tail_a", "tail_b")]
    links = dict(zip(row["pairs"], row["pair_links"]))
    closed = Closed([row["groups"]] if row["groups"] else [], row["n_a"], row["n_b"], row["n_groups"], links)
    return Fragment(tokens[0], tokens[1], row["closes"], closed, tokens[2], tokens[3], row["same"])


_TOKENS = pa.list_(pa.struct([("id", pa.int32()), ("size", pa.int32())]))
_PARTIAL = pa.schema(
    [("key", pa.int64()), ("slot", pa.int64()), ("start", pa.int64()), ("head_a", _TOKENS), ("head_b", _TOKENS), ("closes", pa.bool_())]
    + [("groups", pa.string()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups"))]
    + [("pairs", pa.list_(pa.int64())), ("pair_links", pa.list_(pa.int64())), ("tail_a", _TOKENS), ("tail_b", _TOKENS), ("same", pa.bool_())]
)
PARTIAL_FORM = f"key long, slot long, start long, {PARTIAL}"


def _fragments(path_a: str, path_b: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(path_a, path_b)
        for batch in batches:
            for row in range(batch.num_rows):
                key, start, text = (batch.column(i)[row].as_py() for i in range(3))
                a, b, _, _, same = both.tokens(parts_of(text))
                if same.all():
                    sides = [list(zip(ids.tolist(), e.sizes[ids].tolist())) for ids, e in ((a, both.entries_a), (b, both.entries_b))]
                    made = fragments(*sides, start, size)
                else:
                    made = [(start, Fragment(closes=True, same=False))]
                out = [{"key": key, "slot": at // size, "start": at} | _stored_fragment(f) for at, f in made]
                yield pa.RecordBatch.from_pylist(out, schema=_PARTIAL)

    return run


def _compose(group: pa.Table) -> pa.Table:
    """Neighbouring fragments of a document as one."""
    rows = group.sort_by("start").to_pylist()
    whole = _read_fragment(rows[0])
    for r in rows[1:]:
        whole = whole.then(_read_fragment(r))
    return pa.Table.from_pylist([{"key": rows[0]["key"], "slot": rows[0]["slot"], "start": rows[0]["start"]} | _stored_fragment(whole)], schema=_PARTIAL)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents' fragments to results; those whose bytes differ have no tokens."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            whole = START.then(_read_fragment(row))
            c, done = whole.closed, whole.same and not whole.tail_a and not whole.tail_b
            pairs, n = np.fromiter(c.links, np.int64, len(c.links)), np.fromiter(c.links.values(), np.int64, len(c.links))
            result = (";".join(c.groups).encode(), c.n_a, c.n_b, c.n_groups, pairs, n) if done else NOTHING
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]], pa.int64()), *_results([result])], names=["key", *RESULT_NAMES])


def _composed(parts: DataFrame) -> DataFrame:
    """One fragment a document, composed in rounds of up to ``FAN`` neighbouring ranges."""
    while True:
        most = parts.agg(F.max("slot")).first()[0]
        level = parts.withColumn("slot", F.floor(F.col("slot") / FAN).cast("long"))
        parts = stored(level.groupBy("key", "slot").applyInArrow(_compose, PARTIAL_FORM), "fragments")
        if most is None or most < FAN:
            return parts


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK_BYTES
) -> DataFrame:
    """``carry`` of each row with the alignment of its whole text.

    ``groups`` has the ids of A and B by group, as ``a1,a2|b1;a3|b2,b3``; ``n_a``, ``n_b`` and ``n_groups`` count
    them; ``pairs`` (id of A times 2^32 plus id of B, each once) and ``pair_links`` say how many pairs of
    overlapping tokens have these ids. A text that is null or empty, or whose tokens' bytes are not a space and
    the text (as with a U+2581 in it), has no tokens: an empty ``groups`` and zeros. Repeated rows are rows of
    their own. A document's groups are one value, as its text is. Texts of more than ``chunk`` bytes are aligned
    in fragments by several tasks.
    """
    if not 0 < chunk <= SLICE_BYTES:
        raise ValueError(f"a chunk has 1 to {SLICE_BYTES} bytes")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*carry).alias("row"), whole.alias("text"))
    form = f"row {rows.schema['row'].dataType.simpleString()}"
    long = F.octet_length("text") > chunk
    short = rows.where(~long).mapInArrow(_align(path_a, path_b), f"{form}, {RESULT}")
    keyed = rows.where(long).select(F.monotonically_increasing_id().alias("key"), "row", "text")
    # the keys are made once, in what is written here
    cut = stored(keyed.mapInArrow(_spans(chunk), f"key long, {form}, start long, span string"), "spans")
    if cut.isEmpty():
        return short.select("row.*", *RESULT_NAMES)
    spread = cut.select("key", "start", "span").repartition("key", "start")
    made = stored(spread.mapInArrow(_fragments(path_a, path_b, chunk), PARTIAL_FORM), "fragments")
    finished = _composed(made).mapInArrow(_finish, f"key long, {RESULT}")
    named = cut.where("start = 0").select("key", "row").join(finished, "key").drop("key")
    return short.unionByName(named).select("row.*", *RESULT_NAMES)


def _blocks(size: int):
    """Documents in blocks, each with its different pairs, their links, and the documents' pairs by place in that list."""

    def emit(number: int, rows: list[pa.Array], pairs: list[np.ndarray], links: list[np.ndarray]) -> pa.RecordBatch:
        block = TaskContext.get().partitionId() << 32 | number
        kinds, at = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.concatenate(links)
        totals = np.zeros(len(kinds), np.int64)
        np.add.at(totals, at, n)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))), pa.int32())
        own = pa.StructArray.from_arrays(
            [pa.concat_arrays(rows), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))],
            names=["row", "at", "n"],
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), _lists([kinds]), _lists([totals]), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), own)],
            names=["block", "pairs", "totals", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, pairs, links = 0, 0, [], [], []
        for batch in batches:
            column, counts = batch.column(1), batch.column(2)
            flat, bounds = column.values.to_numpy(), column.offsets.to_numpy()
            n = counts.values.to_numpy()
            for i in range(batch.num_rows):
                lo, hi = bounds[i], bounds[i + 1]
                rows.append(batch.column(0).slice(i, 1))
                pairs.append(flat[lo:hi].copy())
                links.append(n[lo:hi].copy())
                held += hi - lo + 64
                if held >= size:
                    yield emit(number, rows, pairs, links)
                    number, held, rows, pairs, links = number + 1, 0, [], [], []
        if rows:
            yield emit(number, rows, pairs, links)

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the weights of their pairs to rows with ``n_best`` and ``count_sum``."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs, weights = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
            place, count, best = (weights.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            counts, bests = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            counts[place], bests[place] = count, best
            row, at, n = docs.flatten()
            sizes = at.value_lengths().to_numpy(zero_copy_only=False)
            at, n = at.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums = []
            for w in (bests, counts):
                out = np.zeros(len(sizes), np.int64)
                np.add.at(out, owner, n * w[at])
                sums.append(pa.array(out, pa.int64()))
            yield pa.RecordBatch.from_arrays([row, *sums], names=["row", "n_best", "count_sum"])


def count_links(aligned: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``carry`` of each aligned row with ``n_best`` and ``count_sum``, by the corpus-wide counts of pairs of ids.

    A pair's count is the number of links of all rows that hold it. ``count_sum`` adds it up over the row's links;
    ``n_best`` counts those links whose pair has the highest count of its id of B, ties included.
    """
    rows = aligned.select(F.struct(*carry).alias("row"), "pairs", "pair_links")
    kind = rows.schema["row"].dataType.simpleString()
    form = f"block long, pairs array<long>, totals array<long>, docs array<struct<row:{kind},at:array<int>,n:array<int>>>"
    blocks = stored(rows.mapInArrow(_blocks(BLOCK_PAIRS), form), "blocks")
    every = blocks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("totals").alias("total"))))
    counts = stored(every.groupBy("pair").agg(F.sum("total").alias("count")), "pair-counts")
    right = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(right.alias("b")).agg(F.max("count").alias("highest"))
    weights = counts.withColumn("b", right).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    places = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    weighed = places.join(weights, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("weights"))
    both = blocks.select("block", "docs").join(stored(weighed, "weights"), "block", "left")
    filled = both.select("docs", F.coalesce("weights", F.array().cast("array<struct<place:int,count:bigint,best:int>>")).alias("weights"))
    return filled.mapInArrow(_weigh, f"row {kind}, n_best long, count_sum long").select("row.*", "n_best", "count_sum")
