from __future__ import annotations

import numpy as np
from test_decontaminate import ITEM, SCHEMA
from tidemark.llm import decontaminate

SHORT = "Which of the four large moons of the planet is known to be the most volcanic body of all? Io."


def test_one_word_replaced_in_question_and_in_answer(spark, documents):
    """Every single replacement, one in each part, a word left out, a word put in."""
    bench = spark.createDataFrame([(1, ITEM), (2, SHORT)], SCHEMA)
    filler, texts, want = " ".join(f"w{i}" for i in range(60)), [], set()
    for item_id, item in ((1, ITEM), (2, SHORT)):
        words = item.split()
        edited = [words[:n] + ["other" + "?" * w.endswith("?")] + words[n + 1 :] for n, w in enumerate(words)]
        edited += [words[:4] + words[5:], words[:4] + ["other"] + words[4:]]
        if item_id == 1:
            edited.append(words[:4] + ["other"] + words[5:-3] + ["other"] + words[-2:])
        for e in edited:
            want.add((len(texts), item_id))
            texts.append(f"{filler} {' '.join(e)} {filler}")
    docs = documents(texts)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == want
    assert decontaminate.without_leaks(docs, bench).count() == 0


def test_clean_passages_stay(spark, documents):
    """The words of an item in another order, and its question with another answer."""
    bench = spark.createDataFrame([(1, ITEM)], SCHEMA)
    words = ITEM.split()
    texts = [" ".join(words[::-1]), " ".join(sorted(words)), " ".join(words[::2] + words[1::2])]
    texts.append(ITEM.split("?")[0] + "? Nobody has measured every one of them so far.")
    assert decontaminate.without_leaks(documents(texts), bench).count() == len(texts)


def test_edits():
    part, far = np.array([1, 2, 3, 4]), np.full(9, 8)
    for n, middle in ((0, [1, 2, 3, 4]), (1, [1, 2, 9, 4]), (1, [1, 3, 4]), (1, [1, 2, 9, 3, 4]), (4, [])):
        assert decontaminate.edits(part, np.concatenate((far, middle, far)).astype(np.int64)) == n
