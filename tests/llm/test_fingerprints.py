from __future__ import annotations

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp
from tidemark.llm.queries import QUERIES


def exact(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def hashed(shingle):
    seed = 42
    for w in shingle:
        seed = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(w.encode(), 42).to_bytes(8, "little"), seed)
    return seed >> 16


def likeness(a, b, k=fp.K):
    union = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def sketch(text, k=fp.K):
    return sorted({hashed(s) for s in exact(text)})[:k]


def brute(texts):
    ids = sorted(texts)
    out = {}
    for i, n in zip(ids, ids[1:] + ids[:1]):
        t, after = texts[i] or "", texts[n] or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        a, e, b = sketch(t), sketch(edited), sketch(after)
        out[i] = (
            len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(f"{x:x}" for x in a), ",".join(f"{x:x}" for x in e),
            likeness(a, e), likeness(a, b),
        )
    return out


def test_query_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_fingerprints"](spark, small).collect()}
    assert got == brute(texts)
    for i, row in got.items():
        cut = len(texts[i]) // 2
        after = texts[(i + 1) % len(texts)]
        a, b = exact(texts[i]), exact(texts[i][: len(texts[i]) - cut] + after[:cut])
        assert abs(row[4] - (len(a & b) / len(a | b) if a | b else 1)) < 0.12


@pytest.mark.parametrize("block", [1, 3, 512])
def test_blocks_gaps_nulls_and_borders(spark, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    monkeypatch.setattr(fp, "BLOCKS", 2)
    texts = {i: f"{'é' * (i % 5)} text number {i} " * (i % 7) for i in (-9, -1, 0, 1, 2, 7, 8, 40, 41, 3000, 10**12)}
    texts |= {3: None, 5: "", 6: "a b", 9: " \n ", 50: "x " * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in fp.digest(fp.edited_halves(df)).collect()} == brute(texts)


def test_ties_null_ids_empty_tables_and_one_row(spark):
    df = spark.createDataFrame([(None, "n"), (1, "b c d"), (1, "b c d"), (2, "long text here")], "doc_id long, text string")
    df = df.withColumn("fingerprint", F.lit(1)).withColumn("id", F.lit(2))
    rows = fp.edited_halves(df).collect()
    assert sorted(r.edited for r in rows) == sorted(["b cb ", "b clo", "long ten", "n"])
    assert fp.edited_halves(df.limit(0)).count() == 0
    (one,) = fp.edited_halves(df.where("doc_id = 2")).collect()
    assert one.edited == "long te" + "long te"


def test_rows_without_id_follow_each_other_by_hash(spark):
    """Each text of a chain over many rows without id and some equal ones; no block holds many of them."""
    nulls = [f"text {i} of none" for i in range(300)] + ["same words here"] * 3
    rows = [(1, "first text"), (7, "seventh text"), *[(None, t) for t in nulls]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    place = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() >> (64 - fp.NULL_BITS), t)
    chain = ["first text", "seventh text", *sorted(nulls, key=place)]
    want = sorted(t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(chain, chain[1:] + chain[:1]))
    assert sorted(r.edited for r in fp.edited_halves(df).collect()) == want


def test_merge_containment_and_counts(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]), " ".join(words[:1000]))], "a string, b string, c string")
    a, b, c = (fp.sketch(F.col(x)) for x in "abc")
    row = df.select(a.alias("a"), b.alias("b"), c.alias("c")).select(
        fp.resemblance(F.col("a"), F.col("b")).alias("ab"),
        fp.containment(F.col("c"), F.col("a")).alias("ca"),
        fp.containment(F.col("a"), F.col("c")).alias("ac"),
        fp.distinct_shingles(F.col("a")).alias("n"),
        (fp.merged(F.col("a"), F.col("c")) == F.col("a")).alias("same"),
    ).first()
    assert abs(row.ab - 1 / 3) < 0.1 and row.ca > 0.85 and abs(row.ac - 0.5) < 0.12
    assert abs(row.n - 1996) < 400 and row.same


def test_no_python_runs(spark, small):
    plan = QUERIES["op5_fingerprints"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
