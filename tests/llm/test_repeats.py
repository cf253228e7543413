from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import repeats
from tidemark.llm.queries import QUERIES

N = repeats.WINDOW


def brute(texts):
    """``n_words, n_removed, kept`` of each document id, from a table of all windows."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - N + 1):
            first.setdefault(tuple(words[i][s : s + N]), (i, s))
    out = {}
    for i, ws in words.items():
        gone = set()
        for s in range(len(ws) - N + 1):
            if first[tuple(ws[s : s + N])] != (i, s):
                gone.update(range(s, s + N))
        out[i] = (len(ws), len(gone), b" ".join(w for p, w in enumerate(ws) if p not in gone).decode())
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_repeated_passages"](spark, sf).collect()}
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in brute(texts).items()}
    assert sum(gone for _, gone, _ in want.values()) > 0
    assert got == want


def pieces(seed, vocabulary, many):
    rng = random.Random(seed)
    shared = [[f"s{rng.randrange(vocabulary)}" for _ in range(rng.randrange(15, 60))] for _ in range(5)]
    texts = []
    for _ in range(many):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(shared) if rng.random() < 0.5 else [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(40))]
        texts.append(rng.choice(("\t", " ", "\n", "  ", "\x0b")).join(words))
    return texts


@pytest.mark.parametrize("vocabulary", [2, 9, 10**6])
@pytest.mark.parametrize("group", [3, 12, 40, 100_000])
def test_overlaps_borders_and_group_sizes(documents, monkeypatch, vocabulary, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BATCH", 50)
    monkeypatch.setattr(repeats, "ROWS_OUT", 30)
    texts = pieces(vocabulary, vocabulary, 40) + ["la " * 100, "la " * 45, "la " * 19, None, "", " \n", "é " * 20 + "e " * 20]
    assert rows(repeats.remove_repeats(documents(texts))) == brute(dict(enumerate(texts)))


def test_repeated_rows_empty_tables_nulls_and_extra_columns(spark, documents):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(30))
    docs = documents([text, text + " end"]).withColumn("id", F.lit(1)).withColumn("pos", F.lit(2))
    got = repeats.remove_repeats(docs.union(docs)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (0, 0), (1, 30), (1, 30)]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(nameless).collect()] == [0, 0]


def test_nodes_are_shared_prefixes():
    rng = np.random.default_rng(1)
    group, words = np.sort(rng.integers(0, 3, 60)), rng.integers(0, 2, (60, 5))
    out = repeats.nodes(group, words)
    for d in range(6):
        for i in range(60):
            for j in range(60):
                same = group[i] == group[j] and (words[i, :d] == words[j, :d]).all()
                assert (out[i, d] == out[j, d]) == same


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    for _ in range(200):
        window = [f"w{rng.randrange(4)}".encode() for _ in range(N)]
        a = [b"a"] * rng.randrange(9) + window + [b"b"] * rng.randrange(9)
        b = [b"c"] * rng.randrange(9) + window + [b"d"] * rng.randrange(9)
        (ha, _, pa), (hb, _, pb) = repeats.anchors(a), repeats.anchors(b)
        i, j = (next(k for k in range(9) if x[k : k + N] == window) for x in (a, b))
        inside = lambda p, k: {x - k for x in p if k <= x < k + repeats.SPAN}
        shared = inside(pa, i) & inside(pb, j)
        assert shared and all(ha[i + x] == hb[j + x] for x in shared)


def test_windows_of_both_longer_prefixes(documents, monkeypatch):
    """Copies that part from each other on either side of a frequent anchor, at every distance."""
    monkeypatch.setattr(repeats, "GROUP", 6)
    rng = random.Random(11)
    middle = [f"m{i}" for i in range(PREFIX_WORDS)]
    before, after = [f"b{i}" for i in range(30)], [f"a{i}" for i in range(30)]
    texts = []
    for b in range(0, 16):
        for a in range(0, 16, 3):
            own = [f"o{rng.randrange(10**9)}" for _ in range(40)]
            texts.append(" ".join(own[:20] + before[len(before) - b :] + middle + after[:a] + own[20:]))
    assert rows(repeats.remove_repeats(documents(texts))) == brute(dict(enumerate(texts)))


PREFIX_WORDS = repeats.PREFIX
