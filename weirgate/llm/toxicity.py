"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums over their common subsequences of ``ORDER`` characters, each weighted by
``DECAY`` to the power of the stretch it spans in both, so an insult still matches with letters put in or left
out. It is normalized. A sentence is compared with a landmark through its closest word (words of single
letters, "i d i o t", are read as one). The kernel of a pair is zero where the longest common subsequence is
shorter than three fifths of the landmark, which is found for all landmarks at once with bit operations and leaves few
pairs for the kernel itself, and where its value is below ``LEAST``.

Landmarks are words of the training sample: those most tied to toxic documents, no two alike, and frequent
ones of clean documents. Sentences are mapped through the inverse root of the landmarks' own kernel, and a
linear machine with squared hinge loss is trained on them. Only documents carry labels, so sentences of clean
documents are clean, and those of a toxic one are labelled by the machine of the round before, at least one of
them toxic. A document's margin is that of its worst sentence; it becomes a probability with 0.7 where
training documents are told apart best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import stored

ORDER = 4
DECAY = 0.6
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 64, 16
#: Landmarks are no more alike than this.
ALIKE = 0.6
#: Most labelled documents of a class that are used in the fit.
SAMPLE_DOCS = 2_000
MAX_UNIT, UNIT_STEP = 32, 16
MAX_LANDMARK = 16
SENTENCE_WORDS = 64
MAX_CACHED = 300_000
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
CUT = 0.7
LEAST = 0.2


def words_of(text: str) -> list[str]:
    """The words of a text in lower case. A line end is a word "."; runs of three or more single characters are one word."""
    words = text.lower().replace("\n", " . ").split()
    single = [i for i, w in enumerate(words) if len(w) == 1 and w != "."]
    if len(single) < 3:
        return words
    runs, start = [], 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - start >= 3:
                runs.append((single[start], single[k - 1] + 1))
            start = k
    for lo, hi in reversed(runs):
        words[lo:hi] = ["".join(words[lo:hi])]
    return words


def sentence_of(words: list[str]) -> np.ndarray:
    """The sentence of each word. Sentences end after . ! ? and after ``SENTENCE_WORDS`` words."""
    ends = np.fromiter((w[-1] in ".!?" for w in words), dtype=bool, count=len(words))
    number = np.concatenate(([0], np.cumsum(ends)[:-1])) if len(words) else np.zeros(0, np.int64)
    _, first = np.unique(number, return_index=True)
    place = np.arange(len(words)) - first[number] if len(words) else number
    return number * (len(words) // SENTENCE_WORDS + 1) + place // SENTENCE_WORDS


def _units(word: str) -> list[str]:
    """A word without the marks around it; a long one in overlapping pieces."""
    word = word.strip(MARKS)
    if len(word) <= MAX_UNIT:
        return [word]
    return [word[i : i + MAX_UNIT] for i in range(0, len(word) - UNIT_STEP, UNIT_STEP)]


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), dtype=np.uint32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kernel of each pair of rows; rows are code points, filled up with zeros."""
    match = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] != 0)
    weight = match * np.float32(DECAY * DECAY)
    ending = weight
    for _ in range(ORDER - 1):
        total = ending.copy()  # subsequences that end at or before each pair of places, decayed by the distance
        for i in range(1, total.shape[1]):
            total[:, i] += DECAY * total[:, i - 1]
        for j in range(1, total.shape[2]):
            total[:, :, j] += DECAY * total[:, :, j - 1]
        ending = np.zeros_like(weight)
        ending[:, 1:, 1:] = weight[:, 1:, 1:] * total[:, :-1, :-1]
    return ending.sum(axis=(1, 2))


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        self.codes = _codes(words, max(map(len, words)))
        self.lengths = np.array([len(w) for w in words])
        self.own = kernel(self.codes, self.codes)
        letters = sorted({c for w in words for c in w})
        self.letters = np.array([ord(c) for c in letters], dtype=np.uint32)
        self.masks = np.zeros((len(letters) + 1, len(words)), dtype=np.uint32)
        for j, w in enumerate(words):
            for i, c in enumerate(w):
                self.masks[letters.index(c), j] |= np.uint32(1 << i)
        self.enough = np.maximum(ORDER, -(-3 * self.lengths // 5))

    def similar(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of units and landmarks with a kernel above zero, and its normalized value."""
        rows, columns, values = [], [], []
        order = sorted((i for i, u in enumerate(units) if len(u) >= ORDER), key=lambda i: len(units[i]))
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            codes = _codes([units[i] for i in part], len(units[part[-1]]))
            place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
            place[self.letters[place] != codes] = len(self.letters)
            state = np.full((len(part), len(self.words)), np.uint32(0xFFFFFFFF))
            for k in range(codes.shape[1]):  # longest common subsequence, a bit for each landmark character
                hit = state & self.masks[place[:, k]]
                state = (state + hit) | (state - hit)
            common = np.bitwise_count(~state & ((np.uint64(1) << self.lengths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32))
            u, v = np.nonzero(common >= self.enough)
            if not len(u):
                continue
            some = np.unique(u)
            own = np.zeros(len(part))
            own[some] = np.concatenate([kernel(codes[some[i : i + 512]], codes[some[i : i + 512]]) for i in range(0, len(some), 512)])
            both = np.concatenate([kernel(codes[u[i : i + 1024]], self.codes[v[i : i + 1024]]) for i in range(0, len(u), 1024)])
            value = both / np.sqrt(own[u] * self.own[v])
            keep = value >= LEAST
            rows.append(np.array(part)[u[keep]])
            columns.append(v[keep])
            values.append(value[keep])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


class Words:
    """Similarities of words to all landmarks, remembered up to a bound."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.known: dict[str, np.ndarray | None] = {}

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > MAX_CACHED:
            self.known.clear()
            new = words
        new = list(new)
        units, owner = [], []
        for i, w in enumerate(new):
            for u in _units(w):
                units.append(u)
                owner.append(i)
        self.known.update(dict.fromkeys(new))
        rows, columns, values = self.landmarks.similar(units)
        for r, c, v in zip(rows.tolist(), columns.tolist(), values.tolist()):
            word = new[owner[r]]
            row = self.known[word]
            if row is None:
                row = self.known[word] = np.zeros(len(self.landmarks.words))
            row[c] = max(row[c], v)

    def sentence_rows(self, words: list[str]) -> np.ndarray:
        """A row for each sentence that is like a landmark."""
        found = [(i, r) for i, r in enumerate(map(self.known.get, words)) if r is not None]
        if not found:
            return np.zeros((0, len(self.landmarks.words)))
        number = sentence_of(words)[[i for i, _ in found]]
        _, first = np.unique(number, return_index=True)
        return np.maximum.reduceat(np.array([r for _, r in found]), first, axis=0)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    center: float
    slope: float

    def score(self, margin: float) -> float:
        x = np.clip(self.slope * (margin - self.center) + np.log(CUT / (1 - CUT)), -500, 500)
        return float(1 / (1 + np.exp(-x)))


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-6
    w, active = np.zeros(x1.shape[1]), None
    for _ in range(rounds):
        now = y * (x1 @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        xa, ca = x1[active], c[active]
        w = np.linalg.solve(penalty + (xa * ca[:, None]).T @ xa, (xa * (ca * y[active])[:, None]).sum(axis=0))
    return w[:-1], float(w[-1])


def choose_landmarks(texts: list[str], labels: np.ndarray) -> tuple[list[str], int]:
    """Words tied to toxic texts, then the words of clean texts that are most like these; and how many are toxic."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, labels):
        bare = {w.strip(MARKS) for w in words_of(text)}
        seen[label].update(w for w in bare if ORDER <= len(w) <= MAX_LANDMARK)
    toxic, clean = max(int(labels.sum()), 1), max(int((labels == 0).sum()), 1)
    gain = {w: n / toxic * np.log(((n + 0.5) / (toxic + 1)) / ((seen[0][w] + 0.5) / (clean + 1))) for w, n in seen[1].items() if n > 1}
    picked: list[str] = []
    for w in sorted((w for w in gain if seen[1][w] / toxic >= 4 * (seen[0][w] + 1) / clean), key=lambda w: (-gain[w], w))[: 20 * TOXIC_LANDMARKS]:
        if len(picked) == TOXIC_LANDMARKS:
            break
        if not picked or Landmarks(picked).similar([w])[2].max(initial=0) <= ALIKE:
            picked.append(w)
    toxic_ones = len(picked)
    if picked:
        usual = [w for w, n in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[:20_000] if n > 2 * seen[1][w] * clean / toxic / 3 and w not in picked]
        rows, _, values = Landmarks(picked).similar(usual)
        like = np.zeros(len(usual))
        np.maximum.at(like, rows, values)
        near = sorted((i for i in range(len(usual)) if 0.2 < like[i] < 0.95), key=lambda i: (-like[i], i))[:CLEAN_LANDMARKS]
        picked += [usual[i] for i in near]
    return picked, toxic_ones


def fit(texts: list[str], labels: np.ndarray) -> Model | None:
    """A model of labelled texts; None without both labels or without words."""
    words, n_toxic = choose_landmarks(texts, labels) if 0 < labels.sum() < len(labels) else ([], 0)
    if not words:
        return None
    landmarks = Landmarks(words)
    known = Words(landmarks)
    rows = []
    for at in range(0, len(texts), 256):
        part = [words_of(t) for t in texts[at : at + 256]]
        known.learn({w for own in part for w in own})
        rows += [known.sentence_rows(own) for own in part]
    empty = [len(texts)]
    gram = np.eye(len(words))
    r, c, v = landmarks.similar(words)
    gram[r, c] = v
    power, basis = np.linalg.eigh((gram + gram.T) / 2)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(power, 0.05))) @ basis.T
    x = np.vstack([*rows, np.zeros((1, len(words)))]) @ root
    doc = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
    toxic = labels[doc] == 1
    peak = np.concatenate([*(r[:, :n_toxic].max(axis=1, initial=0) for r in rows), [0.0]])
    y = np.full(len(x), -1.0)
    y[:-1][toxic & (peak[:-1] > 0.6)] = 1
    weights, bias = np.zeros(len(words)), -1.0
    for step in range(4):
        if step:
            margin = x @ weights + bias
            y[:-1] = np.where(toxic & (margin[:-1] > 0), 1.0, -1.0)
            for d in np.unique(doc[toxic]):
                own = np.flatnonzero(doc == d)
                if not (y[own] > 0).any():
                    y[own[np.argmax(margin[own])]] = 1
        positive = max((y > 0).sum(), 1)
        share = np.where(y > 0, 1 / positive, 1 / max((y < 0).sum(), 1)) * 200.0
        share[-1] = max(1, min(sum(empty), positive)) / positive * 20.0
        weights, bias = _machine(x, y, share)
    margin = x @ weights + bias
    worst = np.full(len(texts), bias)
    np.maximum.at(worst, doc, margin[:-1])
    center = _best_cut(worst, labels)
    spread = np.abs(worst - center)
    return Model(words, root @ weights, bias, center, float(np.clip(3 / max(np.median(spread), 1e-6), 1, 20)))


def _best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin that tells the labels apart with the best F1: the middle of the gap there."""
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + labels.sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    best = int(np.argmax(f1))
    return float((m[best] + m[best + 1]) / 2) if best + 1 < len(m) else float(m[best] - 1)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS) -> Model | None:
    """Fit on labelled documents: of each class the ``sample`` first by a hash of the key."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    hashed = F.pmod(F.xxhash64("k"), F.lit(1 << 20))
    chosen = None
    for y, n in sorted(counts.items()):
        part = marked.where((F.col("y") == y) & (hashed < int(min(1.0, 2 * sample / n) * (1 << 20)))).orderBy(F.xxhash64("k"), "k").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return None
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).where("text is not null")
    texts, y = [], []
    for row in stored(rows.join(stored(chosen, "chosen"), "k"), "labelled").orderBy("k").toLocalIterator():
        texts.append(row["text"])
        y.append(row["y"])
    return fit(texts, np.array(y, dtype=np.int64)) if texts else None


_WORDS: dict[tuple, Words] = {}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        words = None
        if model is not None:
            key = tuple(model.landmarks)
            if key not in _WORDS:
                _WORDS.clear()
                _WORDS[key] = Words(Landmarks(model.landmarks))
            words = _WORDS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                scores = []
                texts = [words_of(t) for t in part.column(1).fill_null("").to_pylist()]
                if words is not None:
                    words.learn({w for own in texts for w in own})
                for own in texts:
                    if words is None:
                        scores.append(0.0)
                        continue
                    rows = words.sentence_rows(own)
                    margin = model.bias
                    if len(rows):
                        margin = max(margin, float((rows @ model.weights).max()) + model.bias)
                    scores.append(model.score(margin))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` of each row with ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on).

    A null or empty text scores as one without any insult; every text scores 0 when the model is None.
    Columns other than the text are never looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(_score(shared), f"row {kind}, score double")
    return scored.select("row.*", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
