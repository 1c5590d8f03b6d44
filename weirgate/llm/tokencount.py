"""Token counts of whole texts with a public tokenizer file, in Arrow batches that return lengths only.

A text is split where the tokenizer always splits: before a run of white space that follows something else.
Its count is the sum over the parts, so long texts are never encoded at once, and each different part is
encoded once a Python worker, up to a bound. The parts that a worker has not seen go to the library together,
in batches of about ``BATCH_BYTES`` each.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import held

BATCH_BYTES = 1 << 15
MAX_PARTS = 400_000
LONG_PART = 256
PARTS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
AFTER_LETTERS = re.compile(r"(?<=[^\W_])(?=[ \n])")


def safe_parts(text: str) -> list[str]:
    """Parts that add up to the text, cut only where white space follows something else."""
    if OTHER_SPACE.search(text):  # other white space may make one run with a space: cut after letters and digits only
        return AFTER_LETTERS.split(text)
    return PARTS.findall(text)


class Counter:
    """Counts tokens with one tokenizer file: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.encode, self.splits = _library(path)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        parts = [safe_parts(t) if self.splits else [t] for t in texts]
        known = self.known
        new = {p for own in parts for p in own if p not in known}
        if len(known) + len(new) > MAX_PARTS:
            known.clear()
            new = {p for own in parts for p in own}
        for batch in by_bytes(sorted(new), BATCH_BYTES):
            known.update(zip(batch, self.encode(batch)))
        counted = [sum(map(known.__getitem__, own)) for own in parts]
        for p in new:
            if len(p) > LONG_PART:
                del known[p]
        return counted


def by_bytes(parts: list[str], most: int) -> Iterator[list[str]]:
    """Parts in batches of about ``most`` bytes; a longer part is a batch of its own."""
    batch, size = [], 0
    for p in parts:
        n = len(p.encode("utf-8", "surrogatepass"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(p)
        size += n
    if batch:
        yield batch


def _library(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Lengths of encoded texts, and whether texts may be split at white space for this file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    safe = (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not spec.get("normalizer")
        and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ()))
    )
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], safe


def load(path: str) -> Counter:
    return held((Counter, path), lambda: Counter(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, 64):
                counts += counter.counts(batch.column(1).slice(at, 64).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["row", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` of each row with ``n_bytes`` (UTF-8) and ``n_tokens`` of its whole text; a null text is empty.

    Without begin, end or other added tokens. A special token's string inside a text is that token, as the
    library has it by default.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*carry, F.octet_length(whole).cast("long").alias("n_bytes")).alias("row"), whole.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_count(path), f"row {kind}, n_tokens long").select("row.*", "n_tokens")
