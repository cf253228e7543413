"""Every operator over tables with nulls, repeated rows, a very long text and clashing columns."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tidemark.llm import chat, decontaminate, extraction, fingerprints, langid, mixing, neardup, repeats, secrets, urls
from tidemark.plans.stage import stored

CLASHES = "key id score spans host prefix sig size hash item_id part text_ words kept component family lang_pred next_text copies _word _bits _possible _id word bits possible place salt often prefix order _block".split()


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 5000} of text" for i in range(60_000)) + " token = abcdef123456"
    rows = [
        (1, long, "en", "a", 9), (1, long, "en", "a", 9), (2, None, None, None, None), (3, "", "fr", None, 0),
        (None, "no id here", "en", "a", 3), (4, "x", None, "b", 1), (5, "x", "de", "b", 1), (6, " \n\t ", "es", "c", 4),
        (7, "\x00 \ud7ff é 😀 \u3000", "en", "c", 5), (2**62, "far away", "en", "c", 8), (-5, "before all", "en", "c", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return stored(clashing(docs), "odd")


def test_document_operators(spark, odd):
    n = odd.count()
    bench = clashing(spark.createDataFrame([(1, "far away"), (1, "far away"), (None, None), (2, "")], "item_id long, text string"))
    model = langid.train(odd)
    assert repeats.remove_repeats(odd).count() == n
    assert mixing.mix(odd).count() == n
    assert neardup.near_duplicates(odd).count() == n
    assert fingerprints.digest(fingerprints.edited_halves(odd)).count() == n
    assert {r.doc_id for r in decontaminate.matches(odd, bench).collect()} == {2**62}
    assert secrets.scan(odd).where("size(spans) > 0").count() == 2
    assert langid.identify(odd, model, with_runs=True).count() == n
    import test_neardup

    texts = {r.doc_id: r.text for r in odd.where("doc_id IS NOT NULL").collect()}
    want = test_neardup.brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).where("doc_id IS NOT NULL").collect()}
    assert got == want
    # Nothing repeats but in rows of one id, which are one document.
    cut = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(odd).collect()}
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    assert all(cut[i][0] == len(w) and (i == 1 or cut[i][1:] == (0, b" ".join(w).decode())) for i, w in words.items())
    sizes = {(r.doc_id, r.size) for r in mixing.mix(odd).collect()}
    assert {(i, len(w)) for i, w in words.items()} < sizes
    marks = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert {i for i, p in marks.items() if p == "und"} == {2, 3, 6}
    kept = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()}
    assert kept[5] == (4, False) and kept[2] == (2, True) and kept[3] == (3, True)


def test_pipeline_stages(spark, odd):
    docs, columns = odd, odd.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert set(docs.columns) == set(columns)
    assert docs.columns[-1] == "copies" and docs.where("copies IS NULL OR copies < 1").count() == 0


def test_pages_and_conversations(spark):
    html = "<article>" + "<p>A paragraph of text, and more.</p>" * 5000 + "</article>"
    pages = [(1, "http://a.b/c", html), (1, "http://a.b/c", html), (2, None, None), (None, "", ""), (3, "x://" + "h." * 500 + "com/" + "p" * 5000, "<p>x")]
    pages = clashing(spark.createDataFrame(pages, "page_id long, url string, html string")).drop("host").withColumn("text", F.lit(1))
    labels = clashing(spark.createDataFrame([(1, 0, 1), (1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert urls.judge(pages.withColumn("host", F.lit(3)), labels).count() == 5
    assert extraction.extract(pages, extraction.train(pages)).count() == 5
    model = extraction.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    made = extraction.extract(pages, model).collect()
    assert len(made) == 5 and sum(len(r.text) > 100_000 for r in made) == 2
    turns = [(1, 0, "user", "q" * 500_000), (1, 0, "user", "q" * 500_000), (None, None, None, None), (2, None, "assistant", "")]
    turns = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).withColumn("loss", F.lit(1))
    assert {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(turns)).collect()} == {1: 2, None: 1, 2: 1}
