from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokens
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = tokens.Vocabulary.read(PATH)
COUNTER = tokens.TokenCounter(VOCABULARY)


def brute(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_token_counts"](spark, sf).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    assert len(rows) == len(texts)
    assert got == {i: (len(t.encode()), brute(t), brute(t) > 512) for i, t in texts.items()}


ODD = [
    "", " ", "a" * 1000, "aaa aaaa aaaaa", "ab" * 500, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|", " <|endoftext|> a",
    "I'll we've 'tis it's IT'S", "a\n\n\n b \t c  ", "　x y z\x1c\x1d\x85", "½²Ⅷ١٢ 一二三四五六", "😀👩‍👩‍👧 é é", "\x00\x01\x7f",
    "end  ", "\n \n", "'", "''s", "don't'd",
]


def test_odd_texts():
    assert COUNTER.of([*ODD, None]).tolist() == [*map(brute, ODD), 0]


def test_every_character():
    """Each code point between letters, digits, spaces and itself."""
    texts = [f"a{c}b {c}{c}1{c} {c}" for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff"]
    got = COUNTER.of(texts)
    want = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    off = [hex(ord(t[1])) for t, a, b in zip(texts, got, want) if a != b]
    assert not off, (len(off), off[:40])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aabbcde th'e\n 1"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=80), max_size=8))
def test_random_texts(texts):
    assert COUNTER.of(texts).tolist() == [brute(t) for t in texts]


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("etaoinsh", k=rng.randrange(1, 12))) for _ in range(30_000)) + "<|endoftext|>"
    run = "".join(rng.choices("etaoin", k=60_000))
    want = [brute(text), brute(text * 2), brute(run)]
    for piece, known, ragged in ((200_000, 400_000, 1 << 20), (1000, 500, 64)):
        monkeypatch.setattr(tokens, "PIECE", piece)
        monkeypatch.setattr(tokens, "KNOWN", known)
        monkeypatch.setattr(tokens, "RAGGED", ragged)
        assert tokens.TokenCounter(VOCABULARY).of([text, text * 2, run]).tolist() == want


def test_merges_in_rank_order():
    """A small vocabulary against a plain loop that merges the leftmost lowest pair, one at a time."""
    rng = random.Random(5)
    ids = {bytes([b]): b for b in range(256)}
    merges = []
    while len(merges) < 60:
        a, b = rng.choice([k for k in ids if set(k) <= set(b"abc")]), rng.choice([k for k in ids if set(k) <= set(b"abc")])
        if a + b not in ids and len(a + b) < 9:
            ids[a + b] = len(ids)
            merges.append((a, b))
    column = lambda v: np.array(list(v))
    merger = tokens.Merger(tokens.Vocabulary(np.arange(256), column(ids[a] for a, _ in merges), column(ids[b] for _, b in merges), column(ids[a + b] for a, b in merges), []))
    rank = {m: i for i, m in enumerate(merges)}

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not found:
                return len(parts)
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [bytes(rng.choices(b"abc", k=rng.randrange(1, 40))) for _ in range(500)]
    assert merger.count(words).tolist() == [plain(w) for w in words]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, None, 6), (2, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").selectExpr("*", "1 AS key", "2 AS n_bytes", "3 AS over_limit")
    got = sorted(tokens.token_counts(docs, VOCABULARY, limit=1).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 3, 2, True), (1, 3, 2, True), (None, 0, 0, False), (2, 0, 0, False)], key=lambda r: f"Row(doc_id={r[0]}")
    assert tokens.token_counts(docs.limit(0), VOCABULARY).count() == 0
