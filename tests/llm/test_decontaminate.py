from __future__ import annotations

import math
import random
import time

import pytest
from pyspark import cloudpickle

from tidemark.llm import decontaminate
from tidemark.llm.queries import QUERIES

ITEM = "What is the deepest lake on the northern continent by far today? It is the old rift lake in the far east."
SCHEMA = "item_id long, text string"


def norm(text):
    return b" ".join(decontaminate.words_of(text or ""))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: b" " + norm(r.text) + b" " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: b" " + norm(r.text) + b" " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, q in items.items() if q in t}
    rows = QUERIES["op6_benchmark_leaks"](spark, sf).collect()
    assert whole and {(r.doc_id, r.item_id) for r in rows} == whole


def test_leaks_and_near_misses(spark, documents):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "?!"), (5, "one two"), (None, "x y z")], SCHEMA)
    filler = " ".join(f"w{i}" for i in range(500))
    question = ITEM.split("?")[0]
    texts = [
        filler + " " + ITEM + " " + filler,
        ITEM.upper().replace(" ", " \n"),
        filler + " " + question,  # the answer is missing
        None,
        "",
        "the lake is in the far east by the old rift",
        filler + " one, two!",
        "what is " * 3000,
    ]
    docs = documents(texts)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (6, 5)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7]


def test_every_place_of_a_passage(spark, documents):
    """An item is found wherever it begins."""
    bench = spark.createDataFrame([(1, ITEM), (9, "alpha beta gamma delta epsilon zeta")], SCHEMA)
    docs = documents(["w " * n + ITEM + " v" * (90 - n) for n in range(90)])
    assert decontaminate.matches(docs, bench).count() == 90


def test_shards_and_empty_tables(spark, documents, monkeypatch):
    docs = documents([ITEM, "nothing here"])
    bench = spark.createDataFrame([(i, ITEM if i == 3 else f"item {i} has its own words number{i}") for i in range(9)], SCHEMA)
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 2)
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()] == [(0, 3)]
    assert decontaminate.without_leaks(docs, bench).count() == 1
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 2


def plain_scores(docs, items, share=0.6):
    """``(document, item)`` to the best score of every passage and item, one by one."""
    many = len(items)
    words = {i: decontaminate.words_of(t) for i, t in items.items()}
    mean = sum(map(len, words.values())) / many
    holding = {}
    for ws in words.values():
        for w in set(ws):
            holding[w] = holding.get(w, 0) + 1
    out = {}
    for i, ws in words.items():
        weight = {}
        for w in set(ws):
            tf, idf = ws.count(w), math.log(1 + (many - holding[w] + 0.5) / (holding[w] + 0.5))
            weight[w] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        length = decontaminate.Item(i, items[i]).length()
        for d, text in docs.items():
            own = decontaminate.words_of(text)
            for low in range(0, max(1, len(own) - length), length):
                score = sum(weight.get(w, 0.0) for w in set(own[low : low + 2 * length]))
                if score >= share * sum(weight.values()) * (1 - 1e-9):
                    out[d, i] = max(out.get((d, i), 0.0), score)
    return out


def random_case(seed, many=60):
    rng = random.Random(seed)
    vocabulary = [f"w{int(400 * rng.random() ** 3)}" for _ in range(4000)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.randrange(1, 70))) + ". " + " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for i in range(many)}
    docs = {}
    for d in range(40):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 200)))]
        if d % 2:
            ws = items[rng.randrange(many)].split()
            ws[rng.randrange(len(ws))] = "other"
            parts += [" ".join(ws), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 90)))]
        docs[d] = " ".join(parts)
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pruned_search_finds_what_plain_scoring_finds(spark, seed):
    docs, items = random_case(seed)
    bench = spark.createDataFrame(list(items.items()), SCHEMA)
    (index,) = decontaminate.indexes(bench)
    found = list(index.search([decontaminate.words_of(docs[d]) for d in sorted(docs)], 0.8))
    want = plain_scores(docs, items)
    assert {(d, i) for d, i, *_ in found} == set(want)
    assert all(score <= want[d, i] + 1e-9 for d, i, score, *_ in found)


def test_scores_do_not_depend_on_shards(spark, documents, monkeypatch):
    docs, items = random_case(7)
    bench, given = spark.createDataFrame(list(items.items()), SCHEMA), documents([docs[d] for d in sorted(docs)])
    results = []
    for size in (4096, 17, 3):
        monkeypatch.setattr(decontaminate, "SHARD_ITEMS", size)
        results.append(sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.matches(given, bench).collect()))
    assert results[0] and results[0] == results[1] == results[2]


def test_a_full_shard_is_small():
    rng = random.Random(1)
    items = [decontaminate.Item(i, " ".join(f"word{rng.randrange(40_000)}" for _ in range(60))) for i in range(4096)]
    holding = {}
    for item in items:
        for w in set(item.words):
            holding[w] = holding.get(w, 0) + 1
    index = decontaminate.Index(items, 0.6, holding, len(items), 60.0)
    assert len(cloudpickle.dumps(index)) < 100e6
    began = time.perf_counter()
    text = [f"word{rng.randrange(40_000)}".encode() for _ in range(100_000)]
    text[500:560] = items[77].words
    assert [(d, i) for d, i, *_ in index.search([text], 0.8)] == [(0, 77)]
    assert time.perf_counter() - began < 20
