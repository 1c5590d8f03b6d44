"""Packing: plans against brute force, and pieces against the tokenizer library."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, docs, prose
from weirgate.llm.packing import Known, Places, WordIds, closest_filling, pack, plan_windows

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_closest_filling_against_all_subsets(counts, target):
    lengths = sorted(counts, reverse=True)
    sums = {
        sum(n * c for n, c in zip(lengths, used)) for used in itertools.product(*(range(counts[n] + 1) for n in lengths))
    }
    used = closest_filling(lengths, [counts[n] for n in lengths], target)
    assert all(0 < c <= counts[n] for n, c in used.items())
    assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= target)


def laid_out(counts, capacity):
    places, windows = Places(plan_windows(counts, capacity)), defaultdict(list)
    for origin, count in counts.items():
        for number in range(count):
            end = 0
            for start, length, sequence, offset in places.of(origin, number):
                assert start == end and length > 0
                end += length
                windows[sequence].append((offset, length))
            assert end == origin
    return windows


def sound(windows, capacity):
    assert sorted(windows) == list(range(len(windows)))
    short = 0
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
        short += end < capacity
    assert short <= capacity.bit_length()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_windows_are_full(counts):
    sound(laid_out(counts, 64), 64)


def test_plan_does_not_grow_with_the_counts():
    r = random.Random(3)
    counts = {n: r.randrange(1, 10**9) for n in range(1, 2048)}
    assert len(plan_windows(counts, 2048)) < 20_000
    assert plan_windows({}, 2048) == []


def test_exact_fillings_cut_nothing():
    windows = laid_out({1000: 50, 1048: 50, 500: 20, 24: 4}, 2048)
    assert sum(len(parts) for parts in windows.values()) <= 124 + 12


def test_pieces_are_the_library_s_ids(spark):
    texts = [prose(i, 10 + 90 * i) for i in range(40)]
    texts += [None, "", " \n\t ", "Ünïcode WORDS' It's 10,000 x y", "<|endoftext|> a<|startoftext|>b", "é ́x", texts[3], texts[3]]
    texts += [prose(77, 60_000), "z" * 300_000, "A\x0bb\x0cc\x1cd\x85e"]
    rows = docs(spark, texts).union(spark.createDataFrame([(None, "no id here", "en", "s", 1), (3, "id again", "en", "s", 1)], DOCS))
    found = [r.asDict() for r in pack(rows, PATH, carry=("doc_id", "text")).collect()]
    library = Tokenizer.from_file(PATH)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"], r["text"]].append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = defaultdict(list)
    for r in rows.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        expected[r["doc_id"], r["text"]] += ids
    for key, ids in expected.items():
        own = sorted(pieces.pop(key))
        assert {n for _, _, _, n in own} == {len(ids)}
        assert [s for s, *_ in own] == [0, *np.cumsum([n for _, n, _, _ in own])[:-1]]
        assert b"".join(b for _, _, b, _ in own) == np.array(ids, dtype="<u4").tobytes()
        assert all(len(b) == 4 * n for _, n, b, _ in own)
    assert not pieces
    sound(windows, 2048)


def test_units_against_the_library():
    r = random.Random(0)
    letters = "aBcé ÉßÀ×÷'’stSTİΣσςKḴ́hH≠<>|.,!?0123 \t\n\r\x0b\x0c\x1c\x85\xa0你　\x00\x7fªºµÿŸŒ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>x a<|startoftext|>", "H̱ İ", "", "z" * 1000 + " a", "É" * 200]
    words, library = WordIds(PATH), Tokenizer.from_file(PATH)
    for most in (10**6, 200):  # with few places the table is emptied again and again
        words.known = Known(most)
        for at in range(0, len(texts), 100):
            own = texts[at : at + 100]
            ids, bounds = words.encoded(pa.array(own), 1)
            wanted = [library.encode(t, add_special_tokens=False).ids + [1] for t in own]
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == wanted


def test_other_tokenizer_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")  # keeps white space, so texts go to the library whole
    texts = ["Hello  world", None, "", "It's\n\n two"]
    library = Tokenizer.from_file(path)
    found = defaultdict(bytes)
    for r in sorted(pack(docs(spark, texts), path).collect(), key=lambda r: r["start"]):
        found[r["doc_id"]] += bytes(r["ids"])
    assert found == {i: np.array(library.encode(t or "").ids + [1], "<u4").tobytes() for i, t in enumerate(texts)}


def test_no_rows_and_clashing_names(spark):
    assert pack(docs(spark, []), PATH).count() == 0
    clashing = docs(spark, ["a b", None]).selectExpr("doc_id", "text", "'r' AS row", "1 AS chunk", "2 AS rest", "3 AS pieces", "4 AS packed")
    found = pack(clashing, PATH, carry=("doc_id", "row", "chunk", "rest", "pieces", "packed"))
    assert found.columns == ["doc_id", "row", "chunk", "rest", "pieces", "packed", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert sum(r["length"] for r in found.collect()) == 4


def test_registered_query(spark):
    from weirgate.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = QUERIES["op13_packing"](spark, folder).collect()
    library, texts = Tokenizer.from_file(PATH), spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    by_id = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for d, t in texts}
    windows, covered = defaultdict(list), defaultdict(int)
    for r in found:
        ids = by_id[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {d: len(ids) for d, ids in by_id.items()}
    sound(windows, 2048)


@pytest.mark.parametrize("capacity", [1, 2, 3])
def test_tiny_windows(capacity):
    sound(laid_out({n: 5 for n in range(1, capacity + 1)}, capacity), capacity)
