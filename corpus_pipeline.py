"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Documents in no language that the labels name go, of near duplicates one stays, documents that hold a
benchmark item go, secrets are hidden, and the rest is mixed to the sources' target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bloom, decontaminate, langid, mixing, neardup, secrets
from tidemark.llm.common import table
from tidemark.llm.queries import HELD_OUT
from tidemark.plans.stage import stored

#: Least similarity of near duplicates in the corpus, in hundredths, on sets of five-word shingles.
SIMILAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from labelled ones that are not held out."""
    return langid.accepted(docs, langid.train(docs.where(f"NOT ({HELD_OUT})")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component."""
    found = stored(neardup.near_duplicates(docs, similar=SIMILAR), "near_duplicates")
    return bloom.without(docs, "doc_id", found.where("NOT kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    hidden = secrets.hide_secrets(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with ``copies``, the times each is repeated; a column of that name is replaced."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: The stages hold trained models and sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
