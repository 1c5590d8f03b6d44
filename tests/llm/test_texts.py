"""Language, toxicity, tokens, pieces and leaks: against the libraries, brute force, or held-out rows."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from weirgate.llm import decontaminate, langid, toxicity
from weirgate.llm.pieces import Pieces, decode, encode
from weirgate.llm.tokencount import Counter, count_tokens, safe_parts
from weirgate.llm.words import LOWER_BYTE, word_slices

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
EDGE_TEXTS = [
    "", " ", "  a  b ", "a\n\nb \n c", "<|endoftext|>x <|endoftext|> y", "don't  stop 12,345!", "▁ a▁b", "<s> </s> <0x0A>", "x" * 3000,
    "😀 ﬁ é  z \x1c\x85", "日本語 テキスト ру́сский", "퟿  \U0010ffff \x00", " \t\r\n tail \n", "aaaa" * 300, "a b " * 5000,
]
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def own():
    return Pieces(PIECES)


@pytest.fixture(scope="module")
def counters():
    from tokenizers import Tokenizer

    return Counter(BYTES), Tokenizer.from_file(BYTES)


@pytest.mark.parametrize("text", EDGE_TEXTS)
def test_pieces_of_edge_texts(own, library, text):
    ids = own.encode(text, True, True)
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert own.decoded(np.array(ids)).decode() == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeinst \n▁é語"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_pieces_of_any_text(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decoded(np.array(ids, dtype=np.int64)).decode() == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decoding_any_ids(own, library, ids):
    if 0 not in ids:
        assert own.decoded(np.array(ids, dtype=np.int64)).decode() == library.decode(ids)


def test_encode_and_decode_rows(spark, library):
    df = docs(spark, [None, *EDGE_TEXTS]).withColumn("ids", F.lit(1)).withColumn("row", F.lit(2))
    ids = encode(df, PIECES)
    want = [library.encode(t or "", add_bos=True, add_eos=True) for t in [None, *EDGE_TEXTS]]
    assert [r["ids"] for r in ids.orderBy("doc_id").collect()] == want
    assert [r["decoded"] for r in decode(ids, PIECES).orderBy("doc_id").collect()] == [library.decode(w) for w in want]
    assert encode(docs(spark, []), PIECES).collect() == []


@pytest.mark.parametrize("text", EDGE_TEXTS)
def test_counts_of_edge_texts(counters, text):
    assert "".join(safe_parts(text)) == text
    assert counters[0].counts([text]) == [len(counters[1].encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab1.' \n\t  "), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_counts_of_any_text(counters, text):
    assert counters[0].counts([text]) == [len(counters[1].encode(text, add_special_tokens=False).ids)]


def test_count_rows(spark):
    df = docs(spark, [None, "", "Hello world", "é" * 10]).withColumn("n_tokens", F.lit("x"))
    assert [tuple(r) for r in count_tokens(df, BYTES).orderBy("doc_id").collect()][:3] == [(0, 0, 0), (1, 0, 0), (2, 11, 2)]
    piece = count_tokens(docs(spark, ["Hello world"]), PIECES).first()
    assert piece["n_tokens"] == 2
    assert count_tokens(docs(spark, []), BYTES).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB \t\x0b\r é"), max_size=30), min_size=1, max_size=5))
def test_words_are_split_and_hashed_alike(texts):
    import re

    import pyarrow as pa

    seen = {}
    found = 0
    for words in word_slices(pa.array(texts)):
        for i in range(len(words.bounds) - 1):
            want = re.findall(r"[^\x20\x09-\x0D]+", texts[words.first + i])
            at = words.of(i)
            assert [words.data[a:b].tobytes().decode() for a, b in zip(words.starts[at], words.ends[at])] == want
            assert words.joined(i).decode() == " ".join(want)
            for w, h in zip(want, words.hashes[at].tolist()):
                assert seen.setdefault(w, h) == h
            found += 1
    assert found == len(texts) and len(set(seen.values())) == len(seen)
    assert bytes(LOWER_BYTE[list(b"AZaz[@")]) == b"azaz[@"


def test_long_texts_are_hashed_in_slices(monkeypatch):
    import pyarrow as pa

    from weirgate.llm import words as module

    text = prose(3, 5000) + " " + "q" * 3000 + " tail"
    whole = next(word_slices(pa.array([text])))
    monkeypatch.setattr(module, "SLICE_BYTES", 1000)
    sliced = next(word_slices(pa.array([text])))
    assert (whole.hashes == sliced.hashes).all() and (whole.starts == sliced.starts).all()


def test_language_of_held_out_documents(spark):
    from weirgate.llm.queries import op3_language_id

    rows = op3_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.99 * len(rows)


def test_language_edges(spark):
    texts = {"en": ["the cat and the dog"] * 3, "de": ["der hund und die katze"] * 3}
    model = langid.fit(texts)
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, [None, "", "12 !? 3", "The DOG", "hunde", "ß", "the " * 100_000]).withColumn("score", F.lit(1)), model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)][:5] == ["und", "und", "und", "en", "de"]
    assert got[6]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(docs(spark, [])) is None
    assert langid.identify(docs(spark, ["word"]), None).first()["lang_pred"] == "und"


def test_unseen_words_back_off_to_shorter_grams():
    model = langid.fit({"a": ["xyzzy"], "b": ["plugh"]})
    scores, counts = model.text_scores(["xyzzq", "qqplq", "q"])
    assert counts.tolist() == [1, 1, 1]
    assert scores[0].argmax() == 0 and scores[1].argmax() == 1 and (scores[2] == 0).all()


def test_toxicity_of_held_out_documents(spark):
    """Fitted on a third of the labelled rows of the sf0.1 tables' size class, scored on held-out ones."""
    from weirgate.llm.common import label_split

    folder = "/root/testdata/sf0.1"
    all_docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("part", label_split(F.col("doc_id")))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(all_docs.where("part <> 1"), labels)
    rows = toxicity.score(all_docs.where("part = 1"), model).join(labels, "doc_id").collect()
    # a few hundred toxic documents, twenty in the rarest language: far fewer than the fit's bound
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    assert sum(s >= 0.7 for s in toxic) >= 0.75 * len(toxic)
    assert sum(s < 0.7 for s in clean) >= 0.9 * len(clean)
    assert np.mean([(t > np.array(clean)).mean() for t in toxic]) >= 0.85


def test_toxicity_tolerates_gaps_and_inserted_characters(spark):
    r = random.Random(2)
    clean = [prose(i, 30) + "." for i in range(60)]
    toxic = [f"{prose(100 + i, 15)}. you {r.choice(['blockhead', 'nitwit'])} {prose(200 + i, 10)}." for i in range(40)]
    model = toxicity.fit(clean + toxic, np.array([0] * 60 + [1] * 40))
    texts = [None, "", "such a blockhead", "such a bloxckhead", "b l o c k h e a d", "a block of flats", "NITWIT!", "w1 w2 w3"]
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, texts).withColumn("predicted", F.lit(5)), model).collect()}
    assert [got[i]["predicted"] for i in range(8)] == [0, 0, 1, 1, 1, 0, 1, 0]
    assert toxicity.fit(["a"], np.array([1])) is None
    assert toxicity.score(docs(spark, ["x"]), None).first()["score"] == 0.0


def test_kernel_is_the_sum_over_common_subsequences():
    from itertools import combinations

    def brute(a, b):
        total = 0.0
        for i in combinations(range(len(a)), toxicity.ORDER):
            for j in combinations(range(len(b)), toxicity.ORDER):
                if [a[x] for x in i] == [b[x] for x in j]:
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    pairs = [("idiot", "idiot"), ("idxiot", "idiot"), ("aaaaaa", "aaaaa"), ("abcd", "dcba"), ("worthless", "wothles")]
    for a, b in pairs:
        got = toxicity.kernel(toxicity._codes([a], 9), toxicity._codes([b], 9))[0]
        assert got == pytest.approx(brute(a, b), rel=1e-4)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_leaks_are_found_with_target_recall(spark):
    r = random.Random(4)
    items = [(i, prose(1000 + i, r.randrange(12, 50), 3000)) for i in range(60)]
    texts, planted = [prose(i, 300, 3000) for i in range(20)], []
    for i, item in items:
        words = item.split()
        for _ in range(i % (int(decontaminate.SHARE * len(words)) + 1)):
            k = r.randrange(len(words))
            if r.random() < 0.5:
                words[k] = "zz"
            else:
                words.insert(k, "zz")
                words.pop()
        texts.append(f"{prose(2000 + i, 40, 3000)} {' '.join(words).upper()} {prose(3000 + i, 30, 3000)}")
        if brute_distance(words, item.split()) <= int(decontaminate.SHARE * len(words)):
            planted.append((len(texts) - 1, i))
    table = spark.createDataFrame([*items, (900, None), (901, ""), (None, "x y z")], "item_id long, text string").withColumn("matches", F.lit(0))
    got = {(row["doc_id"], m["item"]): m for row in decontaminate.find_items(docs(spark, texts), table).collect() for m in row["matches"]}
    assert len([p for p in planted if p in got]) >= 0.95 * len(planted)
    for (d, i), m in got.items():
        window = texts[d].lower().split()[m["first_word"] : m["first_word"] + m["words"]]
        item = dict(items)[i].split()
        assert brute_distance(window, item) == m["distance"] <= int(decontaminate.SHARE * len(item))
    assert all(d >= 20 for d, _ in got)


def test_leak_edges(spark):
    table = spark.createDataFrame([(1, "alpha beta gamma"), (2, "solo")], "item_id long, text string")
    texts = [None, "", "alpha beta gamma", "x Alpha BETA gamma y", "alpha beta", "solo", "so lo"]
    got = [[m["item"] for m in r["matches"]] for r in decontaminate.find_items(docs(spark, texts), table).orderBy("doc_id").collect()]
    assert got == [[], [], [1], [1], [], [2], []]
    assert decontaminate.find_items(docs(spark, ["solo"]), table.where("false")).first()["matches"] == []
    assert decontaminate.find_items(docs(spark, []), table).collect() == []
