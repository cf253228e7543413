"""Canonical rows and order-independent digests of bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import non_finite_to_null


# How the JSON text spells what it could leave open.
_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def canonical_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text: sorted keys, non-finite numbers as null, times to the microsecond, nothing left out."""
    clean = non_finite_to_null(df)
    columns = [F.col(f"`{c}`") for c in sorted(clean.columns)]
    return clean.select(F.to_json(F.struct(*columns), _JSON).alias("row_json"))


def _combined(digest: Column) -> list[Column]:
    """Sums of the four 64-bit quarters of a SHA-256 text.

    Addition makes the result independent of the row order and combinable in any partition,
    while repeated rows still count.
    """
    return [
        F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(28,0)")).alias(f"_q{i}")
        for i in range(4)
    ]


def _final(sums: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(f"_q{i}"), F.lit(0)).cast("string") for i in range(4)]
    text = F.concat_ws(":", F.col("rows").cast("string"), *parts)
    return sums.select("rows", F.sha2(text, 256).alias("sha256"))


def content_digest(df: DataFrame) -> DataFrame:
    """``rows`` and ``sha256`` of a dataset, equal for any order or partitioning of its rows."""
    digests = canonical_rows(df).select(F.sha2("row_json", 256).alias("_d"))
    return _final(digests.agg(F.count("*").alias("rows"), *_combined(F.col("_d"))))


def hash_tree(df: DataFrame, digits: int = 3) -> DataFrame:
    """``prefix, rows, sha256`` of a tree over a dataset's row hashes, equal for any order of its rows.

    A leaf holds the rows whose hashes begin with the same ``digits`` hexadecimal digits, and is a combinable sum like
    ``content_digest``. A node above is the digest of its at most 16 children with their names, up to the root, whose
    prefix is empty. Rows meet only in sums; the nodes are at most ``16 ** digits`` and a sixteenth more.
    """
    digests = canonical_rows(df).select(F.sha2("row_json", 256).alias("_d"))
    sums = digests.groupBy(F.substring("_d", 1, digits).alias("prefix")).agg(F.count("*").alias("rows"), *_combined(F.col("_d")))
    parts = [F.col(f"_q{i}").cast("string") for i in range(4)]
    level = sums.select("prefix", "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *parts), 256).alias("sha256"))
    out = level
    for depth in range(digits - 1, -1, -1):
        kids = F.array_sort(F.collect_list(F.struct("prefix", "sha256")))
        told = F.array_join(F.transform(kids, lambda k: F.concat(k["prefix"], F.lit(":"), k["sha256"])), ",")
        level = level.groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sha2(told, 256).alias("sha256"))
        out = out.unionByName(level)
    return out


def differing_buckets(one: DataFrame, other: DataFrame) -> DataFrame:
    """``prefix, rows, other_rows`` of the leaves in which two trees of one depth differ."""
    depth = F.length("prefix")
    leaves = [t.filter(depth == t.agg(F.max(depth)).first()[0]) for t in (one, other)]
    renamed = leaves[1].select("prefix", F.col("rows").alias("other_rows"), F.col("sha256").alias("_other"))
    both = leaves[0].join(renamed, "prefix", "full").filter(~F.col("sha256").eqNullSafe(F.col("_other")))
    return both.select("prefix", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("other_rows", F.lit(0)).alias("other_rows"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below a folder."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def directory_digest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Order-independent digest over (path below the folder, file hash)."""
    root = path.rstrip("/") + "/"
    below = F.substring_index("path", root, -1)
    entry = F.sha2(F.concat(below, F.lit(":"), F.col("sha256")), 256)
    digests = file_digests(spark, path, pattern).select(entry.alias("_d"))
    return _final(digests.agg(F.count("*").alias("rows"), *_combined(F.col("_d"))))
