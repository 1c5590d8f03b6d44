"""Alignment of two tokenizers against whole-text encodings by the libraries."""

import functools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import docs, prose
from weirgate.llm.alignment import START, Fragment, align, align_documents, count_links, fragments, spans

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return a, {c: b for b, c in table.items()}, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    a, letters, b = libraries()
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    return left, right


def brute(text):
    """Groups as text, and all links, from the byte ranges of all tokens."""
    if not text:
        return "", [], 0, 0, 0
    left, right = tokens(text)
    raw = (" " + text).encode()
    if b"".join(t for _, t in left) != raw or b"".join(t for _, t in right) != raw:
        return "", [], 0, 0, 0
    ranges = []
    for side in (left, right):
        ends = np.cumsum([len(t) for _, t in side])
        ranges.append([(i, int(e) - len(t), int(e)) for (i, t), e in zip(side, ends)])
    common = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
    groups, lo = [], 0
    for hi in common:
        groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in ranges))
        lo = hi
    links = [(i, j) for i, s, e in ranges[0] for j, s2, e2 in ranges[1] if max(s, s2) < min(e, e2)]
    return ";".join(groups), links, len(left), len(right), len(common)


TEXTS = [prose(i, 5 + 6 * i) for i in range(12)]
TEXTS += ["Hello  world\n\n\tnew line ", " leading", "  two", "\n", " ", "x", "<|endoftext|> and </s> <0x0A> <unk>", "naïve café 你好世界 \U0001f600!"]
TEXTS += [None, "", "a▁b", "▁", "a  b　　 c\x0b d\x1c e\x85 f", "don't I'll we've 1234567 $%^&*", "tail \n \n", "\x00nul", "a;\r\nb()\r\n {\r x\r", TEXTS[3], TEXTS[3]]


def results(rows, key="doc_id"):
    return {r[key]: r for r in rows}


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_against_whole_texts(spark, chunk):
    wanted = [brute(t) for t in TEXTS]
    found = align_documents(docs(spark, TEXTS), A, B, chunk=chunk)
    counted = results(count_links(found, ("doc_id",)).collect())
    total = Counter(x for _, links, *_ in wanted for x in links)
    highest = {}
    for (_, j), n in total.items():
        highest[j] = max(highest.get(j, 0), n)
    found = results(found.collect())
    assert set(found) == set(range(len(TEXTS))) == set(counted)
    for i, (groups, links, n_a, n_b, n_groups) in enumerate(wanted):
        r = found[i]
        assert (r["groups"], r["n_a"], r["n_b"], r["n_groups"]) == (groups, n_a, n_b, n_groups), TEXTS[i]
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(r["pairs"], r["pair_links"])} == Counter(links)
        assert counted[i]["count_sum"] == sum(total[x] for x in links)
        assert counted[i]["n_best"] == sum(total[x] == highest[x[1]] for x in links)


def test_long_texts_are_composed(spark):
    r = random.Random(4)
    giant = "".join(r.choice("abcdefghij") for _ in range(30_000))
    texts = [prose(1, 9000), giant, "word " * 3000 + giant[:7000] + " tail", "你好" * 4000, prose(2, 2000) + "▁" + prose(3, 900), "short"]
    found = results(align_documents(docs(spark, texts), A, B, chunk=2000).collect())
    for i, text in enumerate(texts):
        # links of whole texts by brute force would take squares of their lengths; groups and counts fix them
        left, right = tokens(text)
        if "▁" in text:
            assert (found[i]["groups"], found[i]["n_a"]) == ("", 0)
            continue
        whole = align([(t, len(b)) for t, b in left], [(t, len(b)) for t, b in right])
        assert found[i]["groups"] == ";".join(whole.groups)
        assert (found[i]["n_a"], found[i]["n_b"], found[i]["n_groups"]) == (whole.n_a, whole.n_b, whole.n_groups)
        assert dict(zip(found[i]["pairs"], found[i]["pair_links"])) == whole.links


@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.data(), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_fragments_compose_in_any_order(sizes, data, chunk):
    total = sum(sizes)
    cuts = sorted(data.draw(st.sets(st.integers(1, total - 1), max_size=20))) if total > 1 else []
    a = [(i, n) for i, n in enumerate(sizes)]
    b = [(100 + i, hi - lo) for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, total]))]
    parts = [f for _, f in fragments(a, b, 0, chunk)]
    whole = align(a, b)

    def folded(items):
        if len(items) == 1:
            return items[0]
        k = data.draw(st.integers(1, len(items) - 1))
        return folded(items[:k]).then(folded(items[k:]))

    found = START.then(folded(parts))
    assert ";".join(found.closed.groups) == ";".join(whole.groups) and found.closed.links == whole.links
    assert (found.closed.n_a, found.closed.n_b, found.closed.n_groups) == (whole.n_a, whole.n_b, whole.n_groups)
    assert not found.tail_a and not found.tail_b
    empty = Fragment()
    assert empty.then(parts[0]) == parts[0] and START.then(parts[0]).then(empty) == START.then(parts[0])


def test_links_are_all_overlaps():
    left, right = tokens(TEXTS[6])
    _, links, *_ = brute(TEXTS[6])
    found = align([(t, len(b)) for t, b in left], [(t, len(b)) for t, b in right])
    assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in found.links.items()} == Counter(links)
    assert sum(found.links.values()) == found.n_a + found.n_b - found.n_groups


def test_spans_add_up():
    for text in TEXTS[:14] + ["q" * 5000, "ab cd " * 900]:
        if text:
            found = list(spans(text, 50))
            assert "".join(s for _, s in found) == " " + text
            assert [b for b, _ in found] == [0, *np.cumsum([len(s.encode()) for _, s in found])[:-1]]


def test_no_rows_repeated_ids_and_clashing_names(spark):
    assert count_links(align_documents(docs(spark, []), A, B), ("doc_id",)).count() == 0
    rows = spark.createDataFrame([(None, "one two"), (5, "one two"), (5, "three " * 40), (5, None)], "doc_id long, text string")
    clash = rows.selectExpr("doc_id", "text", "'r' AS row", "1 AS key", "2 AS slot", "3 AS start", "4 AS span")
    found = align_documents(clash, A, B, carry=("doc_id", "row", "key", "slot", "start", "span"), chunk=64)
    assert sorted(r["n_a"] > 0 for r in found.collect()) == [False, True, True, True]
    counted = count_links(found, ("doc_id", "row", "key", "n_a"))
    assert sorted(r["count_sum"] > 0 for r in counted.collect()) == [False, True, True, True]
