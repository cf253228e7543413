"""Queries with SQL, next to their SQL."""

from __future__ import annotations

import pytest

from tidemark.llm.queries import QUERIES, SQL
from workload.check import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    assert compare(spark, small, name, QUERIES[name], SQL[name]).startswith("ok")


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
