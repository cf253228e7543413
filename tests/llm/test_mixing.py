from __future__ import annotations

from tidemark.llm import mixing


def resharing(sizes, weights, cap):
    """Shares by weight, with the excess of capped sources given to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else w[s] * rest / share for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_equal_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, "e": 400, None: 7, "é": 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = resharing(sizes, (5, 2, 1), 3)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-5 for s in want)


def test_takes_come_near_the_target_and_stay_in_bounds(spark, documents):
    texts = ["w " * (1 + i % 7) for i in range(400)] + [None, ""]
    sources = {i: ("hot" if i % 3 == 0 else f"s{i % 5}") for i in range(401)}
    docs = documents(texts, sources=sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 7
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_empty_tables_and_empty_sources(documents):
    assert mixing.mix(documents([]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(documents([None, "", " "])).collect()] == [0, 0, 0]


def test_clashing_columns_and_repeated_rows(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(["a b c", "d e"]).withColumn("size", F.lit(9)).withColumn("hash", F.lit("x"))
    rows = mixing.mix(docs.union(docs)).collect()
    assert sorted(r.size for r in rows) == [2, 2, 3, 3]
