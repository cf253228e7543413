from __future__ import annotations

import itertools
import random

import numpy as np

from tidemark.llm import langid
from tidemark.llm.queries import HELD_OUT, QUERIES


def test_chain_against_all_paths():
    rng = np.random.default_rng(3)
    scores, start, moves = rng.normal(size=(4, 1, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p, both, norm = langid.chain(scores, start, moves)
    total, seen = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(start[path[0]] + sum(scores[t, 0, path[t]] for t in range(4)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t in range(4):
            seen[t, path[t]] += w
    assert np.allclose(p[:, 0], seen / total)
    assert np.isclose(norm, np.log(total))
    assert np.isclose(both.sum(), 3)


def test_decoder_equals_chain():
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.TABLE_ROWS + 1, 2)).astype(np.float32), {}, rng.normal(size=2), rng.normal(size=(2, 2)))
    model.weights[-1] = 0
    docs = [b"one two three four five".split(), b"one two three".split(), b"six".split()]
    means, labels, _ = langid.Decoder(model).decode(docs)
    for d, mean in zip(docs, means):
        p, _, _ = langid.chain(langid.emissions(model, d)[:, None, :].astype(float), model.start, model.moves)
        assert np.allclose(p[:, 0].mean(axis=0), mean)
    assert [len(x) for x in labels] == [5, 3, 1]


def test_grams_stay_within_words():
    alone = [langid.grams([w])[0] for w in (b"ab", b"longer")]
    rows, begins = langid.grams([b"ab", b"longer"])
    for got, want in zip(np.split(rows, begins[1:]), alone):
        assert sorted(got[got < langid.TABLE_ROWS]) == sorted(want[want < langid.TABLE_ROWS])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where(HELD_OUT).collect()}
    rows = QUERIES["op9_language"](spark, sf).collect()
    judged = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and {r.doc_id for r in judged} == set(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.97 * len(judged)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_nulls_and_repeats(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    assert model.labels == ["de", "en", "es", "fr"]
    pick = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("n_chars > 500").collect()}
    texts = [pick["en"] + " " + pick["de"], None, "", "123 !!", pick["fr"], pick["fr"], "é"]
    rows = langid.identify(documents(texts), model, with_runs=True).orderBy("doc_id").collect()
    assert [(r.lang, r.n_words > 25) for r in rows[0].runs if r.n_words > 10] == [("en", True), ("de", True)]
    assert [r.lang_pred for r in rows[1:4]] == ["und"] * 3 and [r.score for r in rows[1:4]] == [0] * 3
    assert rows[4].lang_pred == "fr" and rows[4].score == rows[5].score
    assert rows[6].lang_pred in model.labels


def test_no_labels(documents):
    docs = documents(["some text", None])
    rows = langid.identify(docs, langid.train(docs)).collect()
    assert [r.lang_pred for r in rows] == ["und", "und"]
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def test_control_characters_and_signs_that_are_no_letters(documents):
    docs = documents(["the house and the tree", "das Haus und der Baum", "the\x03 ho\x02use\x03", "½ ²", "Ⅷ ١٢", "\x03"], {0: "en", 1: "de"})
    rows = langid.identify(docs, langid.train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[3:]] == ["und"] * 3
    assert rows[2].lang_pred in ("en", "de")
    words = [b"a\x03b", b"\x03", b"c"]
    got, begins = langid.grams(words)
    for one, part in zip(words, np.split(got, begins[1:])):
        assert sorted(part[part < langid.TABLE_ROWS]) == sorted(x for x in langid.grams([one])[0] if x < langid.TABLE_ROWS)


def test_far_languages_go_and_mixed_short_and_listed_texts_stay(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pick = {r.lang: r.text.split()[:60] for r in docs.where("n_chars > 800").collect()}
    rng = random.Random(2)
    far = [" ".join("".join(rng.choices("абвгдежзиклмнопрст", k=rng.randrange(2, 9))) for _ in range(100)) for _ in range(20)]
    near = [" ".join(pick["en"] + pick["de"] + pick["es"]), " ".join(w + " |" for w in pick["fr"]), pick["de"][0], "12 " * 50 + " ".join(pick["es"])]
    kept = {r.doc_id for r in langid.accepted(documents(far + near), langid.train(docs)).collect()}
    assert kept == {20, 21, 22, 23}
    assert langid.accepted(docs, langid.train(docs)).count() == docs.where("text rlike '[A-Za-z]'").count()
