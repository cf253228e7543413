"""A bounded bitmap of keys: drops most rows that cannot join, before they are shuffled.

The bitmap has some bits for each key, counted first, up to ``2 ** LARGEST`` bits, so its broadcast has a proven
bound. It lets through every key it holds and some others; the join that follows decides. Columns that
are added for a while get names that the rows do not have.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused

#: log2 of the number of bits: at least this, at most this (a million rows of 64 bits, some 50 MB where they are joined).
SMALLEST, LARGEST = 16, 26
#: Bits for each key, as far as the bound allows.
PER_KEY = 16


def size_of(keys: int) -> int:
    """log2 of the number of bits for so many keys."""
    return min(LARGEST, max(SMALLEST, ceil(log2(PER_KEY * keys)))) if keys else SMALLEST


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("long")


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def flagged(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag`` that tells whether ``column`` may be among the one-column ``keys``, which are counted."""
    size = size_of(keys.count())
    word, bits = unused(df, "word"), unused(df, "bits")
    bit = _bit(F.col(keys.columns[0]), size)
    words = keys.groupBy(F.shiftright(bit, 6).alias(word)).agg(F.bit_or(_mask(bit)).alias(bits))
    own = _bit(F.col(column), size)
    held = F.coalesce(F.col(bits).bitwiseAND(_mask(own)) != 0, F.lit(False))
    return df.withColumn(word, F.shiftright(own, 6)).join(F.broadcast(words), word, "left").withColumn(flag, held).drop(word, bits)


def possible(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the values of the one-column ``keys``."""
    flag = unused(df, "possible")
    return flagged(df, column, keys, flag).where(F.col(flag)).drop(flag)


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is none of the keys; only rows that may be are shuffled."""
    flag = unused(df, "possible")
    parted = flagged(df, column, keys, flag)
    unsure = parted.where(F.col(flag)).join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_anti")
    return parted.where(~F.col(flag)).select(df.columns).unionByName(unsure.select(df.columns))
