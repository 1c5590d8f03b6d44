"""SentencePiece merge-type encoding by backtracking, and decoding.

Encoding joins, again and again, the adjacent pieces whose join has the best score. The result has two
properties: every piece encodes to itself, and so does every two adjacent pieces together. The encoder looks
for the sequence with these properties from the left. An Aho-Corasick automaton gives the longest piece at
each place; a piece is taken if it may follow the piece before it, which is found by re-merging the two
together (and remembered); else a shorter one is tried; if none is left, the piece before is given up and the
place is marked as failed in a bit field, so that no place is tried twice.

No piece goes over the start of a run of space marks, so a text is encoded chunk by chunk, a chunk being a
run of space marks and what follows. Encoded chunks are remembered by each Python worker, up to a bound.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import held

SPACE = "▁"
MAX_CHUNKS = 400_000
MAX_PAIRS = 1_000_000
LONG_CHUNK = 512
SLICE_ROWS = 64
REPLACEMENT = "�".encode()


def _fields(message: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a serialized protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, message[at : at + size]
            at += size


class Pieces:
    """Pieces and scores of a model file, with encoding and decoding. The library is used to read the file only."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        parts = dict(_fields(model.serialized_model_proto()))
        trainer, normalizer = dict(_fields(parts[2])), dict(_fields(parts[3]))
        kinds = [int(dict(_fields(v)).get(3, 1)) for f, v in _fields(model.serialized_model_proto()) if f == 1]
        if trainer.get(3, 1) != 2 or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("a merge model without normalization, with a space put before the text, is needed")
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("a model without user-defined or unused pieces is needed")
        names = [model.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if kinds[i] == 1}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a model is needed whose pieces have spaces at their start only")
        self.bytes = {i: int(names[i][3:5], 16) for i in range(n) if kinds[i] == 6}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        #: Characters that are in no longer piece: what stands on either side of them is encoded apart.
        self.joint = {c for p in self.ids if len(p) > 1 for c in p}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        # decoding: the bytes of all pieces in one array
        out = [
            b"" if kinds[i] == 3 else bytes([self.bytes[i]]) if kinds[i] == 6 else b" \xe2\x81\x87 " if kinds[i] == 2 else p.replace(SPACE, " ").encode()
            for i, p in enumerate(names)
        ]
        self.flat = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.sizes = np.array([len(b) for b in out])
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.control = np.array([k == 3 for k in kinds])
        self.is_byte = np.array([k == 6 for k in kinds])
        self.spaced = np.array([len(p) > 0 and p[0] == SPACE and kinds[i] == 1 for i, p in enumerate(names)])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair, leftmost first, until none is left."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, str, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                both = parts[a] + parts[b]
                score = self.scores.get(both)
                if score is not None:
                    heapq.heappush(queue, (-score, a, both, b))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, a, both, b = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def fits(self, first: str, second: str) -> bool:
        """Whether two pieces side by side stay as they are; with an empty first one, whether a piece does."""
        known = self.pairs.get((first, second))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.merged(first + second) == ([first, second] if first else [second])
            self.pairs[first, second] = known
        return known

    def chunk_pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk; a character that the model lacks is a piece of its own."""
        n = len(chunk)
        longest = [1] * n
        for last, size in self.automaton.iter(chunk):
            start = last - size + 1
            if size > longest[start]:
                longest[start] = size
        open_places = bytearray(b"\1") * (n + 1)
        taken: list[str] = []
        at, size, ids, pairs = 0, longest[0], self.ids, self.pairs
        before = ""
        while at < n:
            while size:
                piece = chunk[at : at + size]
                if open_places[at + size] and (size == 1 or piece in ids):
                    fit = pairs.get((before, piece))
                    if fit if fit is not None else self.fits(before, piece):
                        break
                size -= 1
            if size:
                taken.append(piece)
                before = piece
                at += size
                size = longest[at] if at < n else 0
            else:
                open_places[at] = 0
                size = len(taken.pop())
                at -= size
                before = taken[-1] if taken else ""
                size -= 1
        return taken

    def _ids_of(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def _chunk(self, chunk: str) -> bytes:
        packed = self._ids_of(self.chunk_pieces(chunk))
        if len(chunk) <= LONG_CHUNK:
            if len(self.chunks) >= MAX_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        known, out = self.chunks, []
        for line in self._lines(text):
            for chunk in line:
                got = known.get(chunk)
                out.append(self._chunk(chunk) if got is None else got)
        return b"".join(out)

    def _lines(self, text: str) -> Iterator[list[str]]:
        """Chunks of a text with its spaces marked and one put before it."""
        text = SPACE + text.replace(" ", SPACE)
        split_at_ends = "\n" not in self.joint
        for part in text.split("\n") if split_at_ends else [text]:
            if part:
                words = part.split(SPACE)
                if "" in words[1:]:
                    yield list(_runs(words))
                else:
                    chunks = [SPACE + w for w in words[1:]]
                    yield [words[0], *chunks] if words[0] else chunks
            yield ["\n"]

    def encode(self, text: str, begin: bool = False, end: bool = False) -> list[int]:
        ids = np.frombuffer(self.whole(text), dtype="<u4").tolist()
        return [self.begin] * begin + ids + [self.end] * end

    def whole(self, text: str) -> bytes:
        """:meth:`packed` without the line end that :meth:`_lines` puts behind the last line."""
        packed = self.packed(text)
        return packed[: -len(self._line_end())] if packed and "\n" not in self.joint else packed

    def _line_end(self) -> bytes:
        return self.chunks.get("\n") or self._chunk("\n")

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8. The first space is taken off; bytes that are no character become U+FFFD each."""
        ids = ids[~self.control[ids]]
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + sizes, sizes)
        out = self.flat[where].tobytes()
        cut = 1 if self.spaced[ids[0]] else 0
        byte = self.is_byte[ids]
        if not byte.any():
            return out[cut:]
        try:
            out.decode()
            return out[cut:]
        except UnicodeDecodeError:
            pass
        parts, runs = [], np.flatnonzero(np.diff(np.concatenate(([-1], byte.astype(np.int8), [-1]))))
        for a, b in zip(runs[:-1], runs[1:]):
            lo, hi = int(ends[a] - sizes[a]), int(ends[b - 1])
            parts.append(_characters(out[lo:hi]) if byte[a] else out[lo:hi])
        return b"".join(parts)[cut:]


def _characters(raw: bytes) -> bytes:
    """Bytes with each one that belongs to no valid character replaced."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
                out.append(raw[at : at + size])
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(REPLACEMENT)
            at += 1
    return b"".join(out)


def _runs(words: list[str]) -> Iterator[str]:
    """Chunks where several space marks are side by side."""
    marks = ""
    if words[0]:
        yield words[0]
    for w in words[1:]:
        marks += SPACE
        if w:
            yield marks + w
            marks = ""
    if marks:
        yield marks


def load(path: str) -> Pieces:
    """The pieces of a model file, read once in each Python process."""
    return held((Pieces, path), lambda: Pieces(path))


def _encode(path: str, begin: bool, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        head = struct.pack("<I", pieces.begin) if begin else b""
        tail = struct.pack("<I", pieces.end) if end else b""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [head + pieces.whole(t or "") + tail for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(packed)], names=["row", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            column = batch.column(1)
            flat, offsets, known = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_pylist()
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [pieces.decoded(flat[offsets[i] : offsets[i + 1]]) if known[i] else b"" for i in range(at, at + part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "decoded"])

    return run


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Ids as lists."""
    flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _round_trip(path: str, begin: bool, end: bool, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        head = struct.pack("<I", pieces.begin) if begin else b""
        tail = struct.pack("<I", pieces.end) if end else b""
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [head + pieces.whole(t or "") + tail for t in part.column(1).to_pylist()]
                decoded = pa.array([pieces.decoded(np.frombuffer(p, dtype="<u4")) for p in found], pa.binary())
                ids = pa.array(found, pa.binary()) if packed else _lists(found)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded.cast(pa.string())], names=["row", "ids", "decoded"])

    return run


def round_trip(
    docs: DataFrame,
    path: str,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    begin: bool = True,
    end: bool = True,
    packed: bool = False,
) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: ``carry`` of each row with ``ids`` and ``decoded``.

    With ``packed`` the ids are little-endian unsigned 32-bit integers side by side instead of a list.
    """
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    form = f"row {kind}, ids {'binary' if packed else 'array<int>'}, decoded string"
    return rows.mapInArrow(_round_trip(path, begin, end, packed), form).select("row.*", "ids", "decoded")


def encode(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), begin: bool = True, end: bool = True) -> DataFrame:
    """``carry`` of each row with ``ids``, the piece ids of its whole text; a null text is empty."""
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_encode(path, begin, end), f"row {kind}, ids array<int>").select("row.*", "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` of each row with ``decoded``, the text of its ids; null ids are none."""
    rows = encoded.select(F.struct(*carry).alias("row"), F.col(ids).alias("ids"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_decode(path), f"row {kind}, decoded string").select("row.*", "decoded")
