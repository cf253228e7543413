from __future__ import annotations

import random

import corpus_pipeline
import pytest
from test_neardup import rows, shingles
from tidemark.llm import neardup


def similarity(a, b):
    both = len(shingles(a) & shingles(b))
    return both / (len(shingles(a)) + len(shingles(b)) - both)


def components(texts, similar):
    """``n_shingles, component_id, kept`` from all pairs."""
    at = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 100 * similarity(texts[i], texts[j]) >= similar - 1e-9 and at[i] != at[j]:
                low, high = sorted((at[i], at[j]))
                at = [low if x == high else x for x in at]
    return {i: (len(shingles(t)), at[i], at[i] == i) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def texts():
    """Pairs whose similarity lies on both sides of 0.80, most of them between 0.80 and 0.85."""
    rng = random.Random(8)
    out = []
    for n in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        out += [" ".join(base), " ".join(base[: -(26 + n % 10)] + [f"x{n}y{i}" for i in range(26 + n % 10)])]
    return out


def test_planted_pairs_below_the_query(spark, documents, texts):
    planted = [similarity(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.80 <= s < 0.85 for s in planted) >= 20 and min(planted) < 0.80
    want = components(texts, 80)
    made = corpus_pipeline.near_duplicates(spark, documents(texts), "")
    assert {r.doc_id for r in made.collect()} == {i for i, (_, _, kept) in want.items() if kept}
    assert rows(neardup.near_duplicates(documents(texts), similar=80)) == want
    assert rows(neardup.near_duplicates(documents(texts))) == components(texts, 85)


def test_distance_follows_similarity():
    assert [neardup.distance_of(s) for s in (80, 85, 100)] == [19, 16, 0]
    assert neardup.DISTANCE == 16
    with pytest.raises(ValueError):
        neardup.distance_of(0)
