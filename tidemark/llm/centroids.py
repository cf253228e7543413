"""Centroid clustering of whole-number vectors, in JVM expressions alone.

Every vector is turned into integers once and stored. A round is one scan: ``zip_with`` and
``aggregate`` give the squared distance to each centroid, which stands in the plan as a literal
array, ``array_min`` over ``(distance, cluster)`` structs chooses the nearest (ties: the smaller
number), and plain column sums by cluster move the centroids. What reaches the driver in a round is
one row for each centroid, so nothing grows with the input and no vector is shuffled.

Kept are vectors of exactly ``width`` components without null, NaN or infinity; rows that repeat an
id or a vector count as often as they occur, and a null id is kept (its hash comes last). Fewer vectors
than centroids make fewer centroids, none make an empty result. Sums are exact: components
beyond 2 ** 58 count as that, and where the largest component or the number of rows could overflow 64
bits, sums and distances are taken in decimals of 38 digits. A result beyond a long is the largest long.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import require
from tidemark.plans.stage import stored

WIDTH = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024

#: Largest component, and the largest for which a squared distance of ``WIDTH`` components fits a long.
LARGEST = 2**58
NARROW = 2**27
LONG = 2**63 - 1
EXACT = "decimal(38,0)"


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``key, q``: the kept vectors as integers ``floor(scale * x)``."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    return vectors.where((F.size(x) == width) & sound).select(F.col(key).alias("key"), whole.alias("q"))


@dataclass(frozen=True)
class Arithmetic:
    """Plain longs where they cannot overflow, else decimals; both are exact."""

    wide: bool

    def number(self, c: Column) -> Column:
        return c.cast(EXACT) if self.wide else c

    def zero(self) -> Column:
        return F.lit(0).cast(EXACT if self.wide else "long")

    def add(self, a: Column, b: Column) -> Column:
        return (a + b).cast(EXACT) if self.wide else a + b

    def distance(self, q: Column, centroid: list[int]) -> Column:
        """Squared distance to a literal array."""
        fixed = F.array(*[F.lit(v).cast("long") for v in centroid])

        def square(x: Column, y: Column) -> Column:
            d = (x - y).cast("decimal(19,0)") if self.wide else x - y
            return (d * d).cast(EXACT) if self.wide else d * d

        return F.aggregate(F.zip_with(q, fixed, square), self.zero(), self.add)

    def nearest(self, q: Column, centroids: list[list[int]]) -> Column:
        """``(distance, cluster)`` of the nearest centroid."""
        return F.array_min(
            F.array(*[F.struct(self.distance(q, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)])
        )


def seeds(whole: DataFrame, many: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least hashes of their ids."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    return [r.q for r in whole.select("q", order.alias("order")).orderBy(F.col("order").asc_nulls_last(), "q").limit(many).collect()]


def move(whole: DataFrame, centroids: list[list[int]], numbers: Arithmetic) -> list[list[int]]:
    """One round: each centroid becomes the floor of its vectors' mean, or stays if it has none."""
    width = len(centroids[0])
    assigned = whole.select("q", numbers.nearest(F.col("q"), centroids)["cluster"].alias("cluster"))
    columns = [F.sum(numbers.number(F.col("q")[j])).alias(f"s{j}") for j in range(width)]
    moved = list(centroids)
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *columns).collect():
        moved[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return moved


def as_long(c: Column) -> Column:
    return F.least(c, F.lit(LONG).cast(EXACT)).cast("long")


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    width: int = WIDTH,
    many: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid`` of every kept vector.

    Rounds end early once no centroid moves, as all later ones would change nothing.
    """
    require(vectors, key, vector)
    whole = stored(whole_vectors(vectors, key, vector, width, scale), "whole_vectors")
    size, largest = whole.agg(F.count("*"), F.max(F.array_max(F.transform("q", lambda v: F.abs(v))))).first()
    numbers = Arithmetic(wide=bool(size) and (largest >= NARROW or width > WIDTH or largest * size >= 2**62))
    centroids = seeds(whole, many, seed)
    if not centroids:
        none = F.lit(None).cast("long")
        return whole.select(
            F.col("key").alias(key), F.lit(0).alias("cluster"), *[none.alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.col("q").alias("centroid")
        )
    for _ in range(rounds):
        moved = move(whole, centroids, numbers)
        if moved == centroids:
            break
        centroids = moved
    best = whole.select("key", numbers.nearest(F.col("q"), centroids).alias("best")).select("key", "best.cluster", "best.distance")
    own = {r.cluster: int(r.total) for r in best.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("total")).collect()}
    held = F.array(*[F.lit(min(own.get(i, 0), LONG)).cast("long") for i in range(len(centroids))])
    ends = F.array(*[F.array(*[F.lit(v).cast("long") for v in c]) for c in centroids])
    return best.select(
        F.col("key").alias(key),
        "cluster",
        as_long(F.col("distance")).alias("distance"),
        held[F.col("cluster")].alias("cluster_inertia"),
        F.lit(min(sum(own.values()), LONG)).cast("long").alias("inertia"),
        ends[F.col("cluster")].alias("centroid"),
    )


def digest(clustered: DataFrame, key: str = "vec_id") -> DataFrame:
    """The clusters with a hash of each centroid instead of its components."""
    printed = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return clustered.select(key, "cluster", "distance", "cluster_inertia", "inertia", printed.alias("centroid_sha256"))


def printed_centroid(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _near(q: str, cs: str) -> str:
    pairs = f"list_zip({q}, {cs}[i])"
    return f"list_min(list_transform(range(1, len({cs}) + 1), lambda i: {{'d': list_sum(list_transform({pairs}, lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': i - 1}}))"


def _round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT q, ({_near("q", "cs")}).c AS cluster FROM kept, c{i}),
m{i} AS MATERIALIZED (SELECT cluster, list(v ORDER BY j) AS c FROM (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS v FROM (
  SELECT cluster, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, range(1, {WIDTH + 1}) AS t(j) GROUP BY ALL)) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT list(COALESCE(m.c, o.c) ORDER BY o.cluster) AS cs FROM
  (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS cluster FROM c{i}) o LEFT JOIN m{i} m USING (cluster))"""


#: DuckDB SQL of the registered query.
SQL = f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS MATERIALIZED (SELECT list(q ORDER BY h, q) AS cs FROM (SELECT q, sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h, q LIMIT {CENTROIDS})),
{", ".join(map(_round, range(ROUNDS)))},
f AS MATERIALIZED (SELECT vec_id, {_near("q", "cs")} AS best, cs FROM kept, c{ROUNDS})
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cs[best.c + 1], ',')) AS centroid_sha256 FROM f"""
