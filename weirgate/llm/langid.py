"""Language identification by words first, then by shorter and shorter character n-grams.

A word is a longest run of letters, in lower case. For a word that the training texts hold, each language
scores the logarithm of the word's smoothed frequency. For an unseen word, the longest n-grams (from ``ORDER``
characters down to one, with marks for the word's ends) of which the training texts hold any are scored in
the same way and averaged, so one word counts as one word whichever level answers. The sum over all words of
a text, plus the logarithm of each language's share of the training texts, decides.

Words and n-grams are looked up by 64-bit hash in sorted arrays, a slice of text at a time. The model is
fitted on ``SAMPLE_DOCS`` labelled documents of each language at most and holds ``MAX_WORDS`` words and
``MAX_GRAMS`` n-grams of an order at most, so its size does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import held, stored
from weirgate.llm.words import mixed, run_hashes

SLICE_ROWS = 64
SAMPLE_DOCS = 500
MAX_WORDS = 100_000
MAX_GRAMS = 50_000
ORDER = 5
SLICE_CHARS = 1 << 17
UNDETERMINED = "und"
EDGE = 1  # stands before and after a word; no letter

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``SLICE_CHARS``, cut between words."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + SLICE_CHARS, n)
        while end < n and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts and ends of the words of lower-case texts, and the text of each word."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = np.concatenate(([False], _letters()[codes], [False]))
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    breaks = np.cumsum([len(t) + 1 for t in texts])
    return codes, starts, ends, np.searchsorted(breaks, starts, side="right")


def _values(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words with their end marks, and the word of each."""
    lengths = ends - starts + 2
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(starts)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(total) - first[word]
    marked = np.full(total, EDGE, dtype=np.uint32)
    inner = (place > 0) & (place < lengths[word] - 1)
    marked[inner] = codes[(starts[word] + place - 1)[inner]]
    values = _values(marked)
    if size == 1:
        return mixed(values[inner]), word[inner]
    at = np.flatnonzero(place + size <= lengths[word])
    parts = [run_hashes(values[lo : hi + size], at[a:b] - lo, at[a:b] - lo + size) for a, b, lo, hi in _spans(at)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), word[at]


def _spans(at: np.ndarray, step: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
    for a in range(0, len(at), step):
        b = min(a + step, len(at))
        yield a, b, int(at[a]), int(at[b - 1])


def _word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(_values(codes), starts, ends)


@dataclass
class Model:
    """Sorted hashes and, by language, log frequencies: words first, then n-grams from ``ORDER`` down to 1."""

    languages: list[str]
    prior: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    grams: list[tuple[np.ndarray, np.ndarray]]

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log frequency of each word in each language."""
        scores = np.zeros((len(starts), len(self.languages)))
        place = _find(self.words[0], _word_hashes(codes, starts, ends))
        known = place >= 0
        scores[known] = self.words[1][place[known]]
        left = np.flatnonzero(~known)
        for size, (hashes, logs) in zip(range(len(self.grams), 0, -1), self.grams):
            if not len(left):
                break
            grams, word = _grams(codes, starts[left], ends[left], size)
            place = _find(hashes, grams)
            hit = place >= 0
            n = np.bincount(word[hit], minlength=len(left))
            for k in range(len(self.languages)):
                total = np.bincount(word[hit], weights=logs[place[hit], k], minlength=len(left))
                scores[left, k] = np.where(n > 0, total / np.maximum(n, 1), scores[left, k])
            left = left[n == 0]
        return scores

    def text_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores by text and language, and the number of words, of whole texts."""
        total, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        group, owner, size = [], [], 0

        def flush() -> None:
            nonlocal group, owner, size
            if group:
                codes, starts, ends, text = letter_words(group)
                scores, who = self.word_scores(codes, starts, ends), np.array(owner)[text]
                for k in range(len(self.languages)):
                    total[:, k] += np.bincount(who, weights=scores[:, k], minlength=len(texts))
                counts[:] += np.bincount(who, minlength=len(texts))
            group, owner, size = [], [], 0

        for i, text in enumerate(texts):
            for piece in _pieces(text):
                group.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= SLICE_CHARS:
                    flush()
        flush()
        return total, counts


def _find(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted array, or -1."""
    if not len(ordered):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[place] == values, place, -1)


class _Counts:
    """Counts of hashes, summed whenever enough have come in, so memory follows the distinct ones."""

    def __init__(self):
        self.kinds, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += len(hashes)
        if self.size > 500_000:
            self.sum()

    def sum(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        kinds, where = np.unique(np.concatenate([self.kinds, new]), return_inverse=True)
        self.counts = np.bincount(where, weights=np.concatenate([self.counts, n]), minlength=len(kinds)).astype(np.int64)
        self.kinds = kinds


def _table(languages: list[_Counts], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` frequent hashes (ties by value) with add-half smoothed log frequencies by language."""
    for one in languages:
        one.sum()
    kinds = np.unique(np.concatenate([one.kinds for one in languages]))
    counts = np.zeros((len(kinds), len(languages)))
    for k, one in enumerate(languages):
        counts[np.searchsorted(kinds, one.kinds), k] = one.counts
    keep = np.sort(np.lexsort((kinds, -counts.sum(axis=1)))[:most])
    return kinds[keep], np.log(counts[keep] + 0.5) - np.log(counts.sum(axis=0) + 0.5 * len(kinds))


def fit(texts: dict[str, list[str]]) -> Model:
    """A model of texts by language."""
    languages = sorted(texts)
    words = [_Counts() for _ in languages]
    grams = [[_Counts() for _ in languages] for _ in range(ORDER)]
    for k, language in enumerate(languages):
        for text in texts[language]:
            for piece in _pieces(text.lower()):
                codes, starts, ends, _ = letter_words([piece])
                hashes = _word_hashes(codes, starts, ends)
                words[k].add(hashes)
                # n-grams are counted over the distinct words of a piece: they stand for unseen words
                _, once = np.unique(hashes, return_index=True)
                for i, size in enumerate(range(ORDER, 0, -1)):
                    grams[i][k].add(_grams(codes, starts[once], ends[once], size)[0])
    n = np.array([len(texts[language]) for language in languages], dtype=float)
    return Model(languages, np.log((n + 1) / (n.sum() + len(n))), _table(words, MAX_WORDS), [_table(g, MAX_GRAMS) for g in grams])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE_DOCS, languages: int = 1_000) -> Model | None:
    """Fit on the labelled rows of ``docs``: for each language the ``sample`` rows first by a hash of the key.

    At most ``languages`` languages, the most frequent ones. None where no row has a text and a label.
    """
    labelled = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where(
        "text is not null and label is not null"
    )
    counts = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages).collect()
    # the share of rows whose hash is low enough to leave about twice the sample, then the lowest of these
    ranked = None
    for row in counts:
        share = min(1.0, 2.0 * sample / row["count"])
        low = F.pmod(F.xxhash64("k"), F.lit(1 << 62)) < F.lit(max(1, int(share * (1 << 62))))
        part = labelled.where((F.col("label") == row["label"]) & low)
        part = part.orderBy(F.xxhash64("k"), "k").limit(sample)
        ranked = part if ranked is None else ranked.union(part)
    if ranked is None:
        return None
    texts: dict[str, list[str]] = {}
    for row in stored(ranked.select("label", "text"), "sample").toLocalIterator():
        texts.setdefault(row["label"], []).append(row["text"])
    return fit(texts)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = held((Model, shared), lambda: shared.value)
        for batch in _sliced(batches):
            texts = pc.utf8_lower(batch.column(1).fill_null("")).to_pylist()
            n = len(texts)
            if model is None:
                total, counts, names, prior = np.zeros((n, 1)), np.zeros(n, dtype=np.int64), [UNDETERMINED], np.zeros(1)
            else:
                total, counts = model.text_scores(texts)
                names, prior = model.languages, model.prior
            logits = total + prior
            logits -= logits.max(axis=1, keepdims=True)
            odds = np.exp(logits)
            odds /= odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1)
            none = counts == 0
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([UNDETERMINED if none[i] else names[best[i]] for i in range(n)], pa.string()),
                    pa.array(np.where(none, 0.0, odds[np.arange(n), best]), pa.float64()),
                ],
                names=["row", "text", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` of each row of ``docs`` with ``lang_pred`` and ``score``, the language's probability by the model.

    A null text and one without a letter get ``und`` and 0; so does every text when the model is None. Ties
    go to the language first by name. Columns other than the text are never looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the text goes to Python and back once, also where it is carried
    others = [c for c in carry if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("__none"), *others).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_predict(shared), f"row {kind}, text string, lang_pred string, score double")
    carried = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in carry]
    return found.select(*carried, "lang_pred", "score")
