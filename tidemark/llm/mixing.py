"""Mixing sources to target weights by capped water-filling.

Sources share the budget by weight; none may exceed ``max_epochs`` times its own size, and what
a capped source leaves is shared by weight among the others. Pouring to the level ``r`` fills
source ``i`` with ``min(w_i * r, cap_i)``, so a source is capped exactly when pouring to its own
level ``cap_i / w_i`` uses no more than the budget. That is one running sum over the sources and
the fixed point of repeated resharing.

A source then takes every document ``floor(target / size)`` times, and once more those documents
that come first in a seeded hash order until the rest is used up; the document at the edge is
taken if that brings the sum closer. The order is cut into hash buckets, so a source of any
size is ranked in many small windows; only one row for each (source, bucket) is summed per source.

Null text counts no words; null sources form one source, last in order. An empty table gives
no rows; a source without words takes none. Equal rows are ranked one after the other; rows without id are
ordered by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import require, unused, word_count
from tidemark.plans.stage import stored

#: Hex digits of the hash that name a bucket: 16 ** 4 buckets a source.
BUCKET_DIGITS = 4


def row_hash(seed: str, key: str, text: str) -> Column:
    """Place of a row in the seeded order: by its id, without one by its text."""
    known = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))
    return F.md5(F.concat(F.lit(seed + ":"), known))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from one row ``source, size`` for each document.

    Weights are dealt to the sources in code-point order, null last, and repeat.
    """
    one = F.lit(1)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    # One row a source from here on; only these meet in one window.
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.partitionBy(one).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(one).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(one)
    poured = F.col("cap") * F.col("weight_on") + F.col("weight") * F.col("caps_before")
    level = (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)) / F.nullif(
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything), F.lit(0)
    )
    return (
        capped.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_on", F.sum("weight").over(onward))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", poured <= F.col("total") * F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")))
        .select("source", "source_size", F.round("target", 6).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix-1",
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """One row a document: ``key, source, size, source_size, target, copies, taken`` and ``hash``, its place in the order."""
    require(docs, text, source, key)
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(seed, key, text).alias("hash")
    ).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    # A null source must meet itself in joins.
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    sized = stored(sized.withColumn("name", name), "sizes")  # texts are read once
    targets = source_targets(sized, weights, max_epochs).withColumn("name", name).drop("source")
    buckets = (
        sized.groupBy("name", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .join(targets, "name")
        .withColumn(
            "start",
            F.coalesce(
                F.sum("bucket_size").over(
                    Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("bucket_size")
    )
    inside = Window.partitionBy("name", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    once_more = F.col("before") + F.col("size") / 2 < F.col("target") - F.col("whole") * F.col("source_size")
    return (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(buckets, ["name", "bucket"])
        .withColumn("before", F.col("start") + F.col("inside"))
        .withColumn("whole", whole.cast("long"))
        .withColumn("copies", F.col("whole") + once_more.cast("long"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            "hash",
        )
    )


def mixed_documents(docs: DataFrame, seed: str = "mix-1", key: str = "doc_id", text: str = "text", **settings: object) -> DataFrame:
    """The documents of the mix with ``copies``, the times each is repeated; a column of that name is replaced.

    Rows that share an id, or without id a text, share the larger of their copies.
    """
    name = unused(docs, "place")
    chosen = mix(docs, seed=seed, key=key, text=text, **settings).groupBy(F.col("hash").alias(name)).agg(F.max("copies").alias("copies"))
    return docs.drop("copies").withColumn(name, row_hash(seed, key, text)).join(chosen.where("copies > 0"), name).drop(name)


def _sql(documents: str, seed: str) -> str:
    return f"""WITH d AS (SELECT doc_id, source,
  CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5('{seed}:' || COALESCE(CAST(doc_id AS VARCHAR), 'text:' || COALESCE(text, ''))) AS h FROM {documents}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w,
  source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, CAST(COALESCE(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps,
  CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws,
  CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, cap * ws + w * caps <= total * w AS is_full FROM s2),
s4 AS (SELECT *, CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE)
  / CAST(NULLIF(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) AS DOUBLE) AS level FROM s3),
s5 AS (SELECT source, source_size,
  round(CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE w * level END, 6) AS target FROM s4),
o AS (SELECT *, CAST(COALESCE(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
j AS (SELECT o.*, s5.source_size, s5.target,
  CASE WHEN s5.source_size > 0 THEN CAST(floor(s5.target / s5.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM o JOIN s5 ON o.source IS NOT DISTINCT FROM s5.source),
mixed AS (SELECT *, whole + CASE WHEN before + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END AS copies FROM j)
"""


#: DuckDB SQL of the registered query.
SQL = (
    _sql("documents", "mix-1")
    + "SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed"
)
