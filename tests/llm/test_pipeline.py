from __future__ import annotations

import re

import corpus_pipeline
import pytest
from test_neardup import brute as components
from test_mixing import resharing
from test_secrets import brute as spans
from tidemark.llm import decontaminate
from tidemark.plans.stage import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    """What every stage was given and made."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), made.collect(), made.columns)
        docs = made
    return out


def test_columns(results):
    for name, (_, _, columns) in list(results.items())[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_texts_with_letters(results):
    given, made, _ = results["language"]
    assert len(made) >= 0.99 * sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in given)


def test_one_of_each_component_stays(results):
    given, made, _ = results["near_duplicates"]
    want = {i for i, (_, _, kept) in components({r.doc_id: r.text for r in given}, corpus_pipeline.SIMILAR).items() if kept}
    assert {r.doc_id for r in made} == want < {r.doc_id for r in given}


def test_documents_with_items_go(spark, results):
    given, made, _ = results["decontamination"]
    norm = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in given if not any(i in norm(r.text) for i in items)}
    assert {r.doc_id for r in made} == want < {r.doc_id for r in given}


def test_secrets_are_hidden_and_no_document_goes(results):
    given, made, _ = results["secret_scan"]
    before = {r.doc_id: r.text for r in given}
    assert {r.doc_id for r in made} == set(before)
    assert not any(spans(r.text) for r in made)
    assert all(r.text == before[r.doc_id] for r in made if not spans(before[r.doc_id]))
    assert all(r.n_chars == len(r.text) for r in made)


def test_mix_is_near_its_targets(results):
    given, made, _ = results["source_mix"]
    size = {r.doc_id: len(r.text.split()) for r in given}
    of = {}
    for r in given:
        of.setdefault(r.source, []).append(size[r.doc_id])
    target = resharing({s: sum(v) for s, v in of.items()}, (5, 2, 1), 3)
    for s in of:
        got = sum(size[r.doc_id] * r.copies for r in made if r.source == s)
        assert abs(got - target[s]) <= max(of[s])
    assert all(1 <= r.copies <= 3 for r in made)


def test_run_equals_its_stages(spark, results):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in results["source_mix"][1])


def test_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "some words", None, "s", 10), (None, "x y", "fr", "s", 3)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        assert docs.count() <= len(rows)
