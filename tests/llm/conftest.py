from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def documents(spark):
    """A function from texts to a documents table with ids from 0."""

    def make(texts, langs=None, sources=None):
        rows = [
            (i, t, (langs or {}).get(i), (sources or {}).get(i), None if t is None else len(t)) for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
