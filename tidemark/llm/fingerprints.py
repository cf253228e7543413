"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A fingerprint holds the ``K`` least distinct 48-bit hashes of a text's five-word shingles in ascending order. Those of
parts merge into that of the whole, and two of them estimate resemblance and containment; one estimates the number of
distinct shingles. Texts with up to ``K`` shingles are told exactly.

A text with fewer than five words is one shingle; without words, and null, it has an empty
fingerprint. Two empty fingerprints resemble each other fully, an empty one and another not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bloom import possible
from tidemark.llm.common import require
from tidemark.plans.stage import stored

K = 256
SHINGLE = 5
HASH_BITS = 48

#: Ids in a block of documents, and blocks in a group of blocks.
BLOCK = 512
BLOCKS = 4096
#: Bits of the hash that names the block of a row without id.
NULL_BITS = 20


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(text: Column) -> Column:
    """Distinct hashes of the text's shingles, ascending."""

    def of(h: Column) -> Column:
        last = F.size(h) - SHINGLE + 1
        each = F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(-1, SHINGLE - 1)]),
        )
        return F.when(F.size(h) > 0, each).otherwise(F.array().cast("array<bigint>"))

    hashes = let(F.transform(words(text), lambda w: F.xxhash64(w)), of)
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda x: F.shiftrightunsigned(x, 64 - HASH_BITS))))


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(shingle_hashes(text), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of the texts of both."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of the shingles of both."""

    def of(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))

    return let(merged(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the k-th least hash."""
    n = F.size(a)
    far = (F.element_at(a, -1) + 1).cast("double") / float(2**HASH_BITS)
    return F.when(n < k, n.cast("double")).otherwise((k - 1) / far)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Part of the first's shingles that the second holds."""
    near = resemblance(a, b, k)
    both = near / (1 + near) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ",")


def _part(number: Column, width: int) -> Column:
    """Which of the parts of this width holds the whole number."""
    return F.call_function("div", number - F.pmod(number, F.lit(width)), F.lit(width))


def with_next(docs: DataFrame, key: str, columns: tuple[str, ...], make) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows by ascending key; the first follows the last.

    ``make`` adds the columns, which must not be null, to rows of ``docs``. Rows are read in blocks of consecutive keys, so no
    task holds more than a block; the last row of a block is given the first of the next, which
    is found among the blocks' first keys alone. Null keys come last, ordered by a hash of ``columns[0]``, whose leading
    bits are their blocks, so they are spread however many they are; equal keys are ordered by the columns.
    """
    last = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64(columns[0]), 64 - NULL_BITS)
    home = F.coalesce(_part(F.col(key), BLOCK), last)
    placed = docs.withColumn("_block", home)
    blocks = stored(placed.groupBy("_block").agg(F.min(key).alias("_first")).withColumn("_group", _part(F.col("_block"), BLOCKS)), "blocks")
    heads = blocks.groupBy("_group").agg(F.min("_block").alias("_head"))
    order = Window.partitionBy(F.lit(1)).orderBy("_group")  # a row for each BLOCK * BLOCKS keys
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_head", F.coalesce(F.lead("_head").over(order), F.first("_head").over(first)))
    follows = blocks.join(heads, "_group").select(
        "_block",
        F.coalesce(F.lead("_block").over(Window.partitionBy("_group").orderBy("_block")), F.col("_head")).alias("_next"),
    )
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(F.col(key).asc_nulls_last(), *columns))
    heading = placed.where(F.col(key).isNull()).unionByName(
        possible(placed, key, blocks.select("_first")).join(blocks.select(F.col("_first").alias(key)), key, "left_semi").select(placed.columns)
    )
    firsts = (
        make(heading)
        .withColumn("_rank", rank)
        .where("_rank = 1")
        .select(F.col("_block").alias("_next"), *[F.col(c).alias(f"_first_{c}") for c in columns])
    )
    inside = Window.partitionBy("_block").orderBy(F.col(key).asc_nulls_last(), *columns)
    rows = make(placed).select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in columns])
    given = follows.join(firsts, "_next").drop("_next")
    return rows.join(given, "_block").select(
        *docs.columns,
        *[c for c in columns if c not in docs.columns],
        *[F.coalesce(f"next_{c}", f"_first_{c}").alias(f"next_{c}") for c in columns],
    )


def edited_halves(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the next text's beginning."""
    require(docs, key, text)
    given = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(given, "id", ("text", "fingerprint"), lambda df: df.withColumn("fingerprint", sketch(F.col("text"), k)))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    full = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited")).withColumn(
        "edited_fingerprint", sketch(F.col("edited"), k)
    )
    return full.select(F.col("id").alias(key), "n_chars", "edited", "fingerprint", "edited_fingerprint", F.col("next_fingerprint"))


def digest(full: DataFrame, key: str = "doc_id", k: int = K) -> DataFrame:
    """The fingerprints as text, the edited text's digest, and the likenesses."""
    a, e, n = (F.col(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    judged = full.withColumns(
        {"edited_sha256": F.sha2(F.col("edited"), 256), "near_edited": resemblance(a, e, k), "near_next": resemblance(a, n, k)}
    ).select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return judged.withColumns({"fingerprint": printed(a), "edited_fingerprint": printed(e)})
