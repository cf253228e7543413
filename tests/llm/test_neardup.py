from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import bloom, graph, neardup
from tidemark.llm.queries import QUERIES


def shingles(text):
    words = neardup.FOLD and (text or "").encode().translate(neardup.FOLD).split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def brute(texts, similar=85):
    """Row for each document id, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    at = {i: i for i in texts}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(texts)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    seen = {}
    for hs in holders.values():
        for n, a in enumerate(hs):
            for b in hs[n + 1 :]:
                seen[a, b] = seen.get((a, b), 0) + 1
    for (a, b), both in seen.items():
        if 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            at[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows(QUERIES["op4_near_duplicates"](spark, sf)) == brute(texts)


def test_edges_of_similarity_nulls_and_short_texts(documents):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for cut in (5, 20, 22, 23, 24, 25, 40):
        texts.append(" ".join(base[:-cut] + [f"x{cut}y{i}" for i in range(cut)]))
    for n in range(12):  # a chain: each near the next
        texts.append(" ".join(base[8 * n :] + [f"z{i}" for i in range(8 * n)]))
    texts += [None, "", "  ", "a b", "A  b", "b a", "one two three four five", "ONE two three\nfour five", "É b", "é b"]
    assert rows(neardup.near_duplicates(documents(texts))) == brute(dict(enumerate(texts)))


def test_parts_of_buckets_and_loosely_similar_groups(documents, monkeypatch):
    monkeypatch.setattr(neardup, "PART_ROWS", 7)
    monkeypatch.setattr(neardup, "PART_SHINGLES", 900)
    monkeypatch.setattr(neardup, "CELLS", 4000)
    rng = random.Random(5)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join(shared + [f"u{i}_{j}" for j in range(rng.choice((8, 12, 16, 25)))]) for i in range(80)]
    assert rows(neardup.near_duplicates(documents(texts))) == brute(dict(enumerate(texts)))


def test_repeated_rows_empty_table_and_extra_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(["a b c d e f", "x y z a b c"]).withColumn("key", F.lit(1)).withColumn("sig", F.lit(2))
    got = neardup.near_duplicates(docs.union(docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.kept for r in neardup.near_duplicates(nameless).collect()] == [True, True]


def test_pigeonhole_keys_hold_every_near_pair():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**16, neardup.SYMBOLS).astype(np.uint16)
    for _ in range(300):
        b = a.copy()
        wrong = rng.choice(neardup.SYMBOLS, rng.integers(0, neardup.DISTANCE + 1), replace=False)
        b[wrong] += 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], ["id", "sig"])
        (out,) = neardup._keys(iter([batch]))
        keys = {1: set(), 2: set()}
        for i, k in zip(*(c.to_pylist() for c in out.columns)):
            keys[i].add(k)
        assert keys[1] & keys[2]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 200: 200, 201: 200}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_loses_no_key(spark):
    held = bloom.possible(spark.range(2000), "id", spark.range(0, 2000, 10).toDF("k"))
    got = {r.id for r in held.collect()}
    assert set(range(0, 2000, 10)) <= got and len(got) < 260
