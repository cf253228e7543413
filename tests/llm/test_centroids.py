from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import centroids
from tidemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, width=64, many=8, rounds=10):
    """Row for each kept vector, in whole numbers of any size."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [max(-(2**58), min(2**58, math.floor(1024 * float(np.float32(v))))) for v in x]))
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    cs = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:many]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cs = [[sum(col) // len(groups[i]) for col in zip(*groups[i])] if i in groups else c for i, c in enumerate(cs)]
    found = [(i, *near(q)) for i, q in kept]
    top = 2**63 - 1
    inertia = {}
    for _, d, c in found:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, min(d, top), min(inertia[c], top), min(sum(inertia.values()), top), sha[c]) for i, d, c in found), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_centroid_clusters"](spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert rows(got) == brute(table)


def clustered(spark, table):
    df = spark.createDataFrame([(i, x, 0) for i, x in table], SCHEMA).selectExpr("*", "1 AS q", "2 AS key", "3 AS cluster", "4 AS best")
    return rows(centroids.digest(centroids.cluster(df)))


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vec = lambda: rng.normal(size=64).astype(np.float32).tolist()
    same = vec()
    table = [(i, vec()) for i in range(60)]
    table += [(100, same), (100, same), (101, same), (None, vec()), (102, None), (103, []), (104, same[:63]), (105, same + [1.0])]
    table += [(106, [None, *same[1:]]), (107, [float("nan"), *same[1:]]), (108, [float("inf"), *same[1:]]), (109, [0.0] * 64), (110, [-1e-30] * 64)]
    assert clustered(spark, table) == brute(table)


def test_few_none_and_equal_vectors(spark):
    table = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    assert clustered(spark, table) == brute(table)
    assert clustered(spark, [(1, [0.5] * 3)]) == [] and clustered(spark, []) == []


def test_huge_components_are_exact_and_saturate(spark):
    rng = np.random.default_rng(6)
    table = [(i, (rng.normal(size=64) * 10.0 ** (i % 12)).astype(np.float32).tolist()) for i in range(40)]
    assert clustered(spark, table) == brute(table)
    table += [(50, [3e38] * 64), (51, [-3e38] * 64), (52, [1e15] * 64)]
    got = clustered(spark, table)
    assert got == brute(table) and any(r[4] == 2**63 - 1 for r in got)


def test_both_kinds_of_numbers_agree(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist(), 0) for i in range(50)], SCHEMA)
    whole = centroids.whole_vectors(df).cache()
    cs = centroids.seeds(whole)
    assert centroids.move(whole, cs, centroids.Arithmetic(False)) == centroids.move(whole, cs, centroids.Arithmetic(True))


def test_plan_has_no_python_and_no_join(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = centroids.whole_vectors(df)
    assigned = whole.select("key", centroids.Arithmetic(False).nearest(whole["q"], centroids.seeds(whole)).alias("best"))
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan
