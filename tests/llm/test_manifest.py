from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(hashes):
    """Levels of a tree from its leaves up."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def others(levels, i):
    """``(before, after)`` of the node's run at every level."""
    for level in levels[:-1]:
        first = i // 16 * 16
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 16])
        i //= 16


def brute(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (first(r.doc_id), leaf(r, r.text)))
        trees.append((own, grow([leaf(r, r.text) for r in own])))
    top = grow([levels[-1][0] for _, levels in trees])
    out = []
    for t, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            steps = [*others(levels, i), *others(top, t)]
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for a, b in steps:
                node = sha(a + node + b)
            root = top[-1][0]
            out.append((r.doc_id, levels[0][i], levels[-1][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = QUERIES["op13_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = rows(got)
    assert found == brute(docs)
    assert {r[-1] for r in found} == {True, False}


def check(spark, table):
    df = spark.createDataFrame(table, SCHEMA)
    clash = df.selectExpr("*", *[f"1 AS {c}" for c in "key hash tree height at block runs kids path root _part _at _first changed".split()])
    assert rows(manifest.digest(manifest.manifest(clash))) == brute(df.collect())


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [257, 1, 16], [4097, 256, 1], [1] * 17, [3] * 300])
def test_tree_shapes(spark, sizes):
    n = 0
    table = []
    for s, size in enumerate(sizes):
        table += [(n + i, f"Text {n + i}", "en", f"s{s}", 9) for i in range(size)]
        n += size
    check(spark, table)


def test_nulls_repeats_and_ties(spark):
    table = [(1, "A", "en", "a", 1)] * 3 + [(1, "B", "en", "a", 1), (None, "C", None, "a", None), (None, None, None, None, None), (None, None, None, None, None)]
    table += [(2, "", "", "", 0), (3, None, "", "", 0), (-4, "Ünï 😀 Z", "fr", "é", 7), (5, "x", "en", "z", 1), (2**62, "LONG " * 50_000, "en", "Z", 250_000)]
    check(spark, table)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest.digest(manifest.manifest(empty)).collect() == []


def test_a_changed_text_is_noticed(spark):
    df = spark.createDataFrame([(i, f"Text {i}", "en", "s", 6) for i in range(200)], SCHEMA)
    found = manifest.digest(manifest.manifest(df))
    hit = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(r.doc_id for r in found.where("NOT verified").collect()) == hit


def test_no_join_touches_a_row_and_one_exchange_carries_it(spark):
    nodes = spark.range(5000).select((F.col("id") % 3).alias("tree"), (F.col("id") % 3 + 4).cast("int").alias("height"), F.floor(F.col("id") / 3).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    plan = manifest.nested(nodes, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Python" not in plan
