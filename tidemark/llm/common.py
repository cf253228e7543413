"""Helpers of the text operators: tables, word pattern, column defaults, worker functions."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space characters. ``bytes.split()`` cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_value(module: str) -> None:
    """Send the module's functions to executors inside the task, so none needs the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def give_back() -> None:
    """Return freed memory to the system. A worker serves the tasks of later stages and else keeps the most it ever had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run``, a task's generator, with its memory given back once it has ended."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this that the rows do not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread out."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A hash for every ``width`` consecutive words; none if there are fewer."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for j in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    return mixed(out)


by_value(__name__)
