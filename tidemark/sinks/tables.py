"""Table sinks: Parquet, contract CSV, JSON results and immutable snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import non_finite_to_null
from tidemark.sinks.digests import content_digest

# Time and number format of the contract CSV files.
ISO_WITH_OFFSET = "yyyy-MM-dd'T'HH:mm:ssXXX"
SIX_DECIMALS = "%.6f"


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet through the job commit protocol: readers see all of it or nothing."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def contract_text(df: DataFrame) -> DataFrame:
    """Times as ISO-8601 with offset, doubles with six decimals, the column order kept."""
    columns: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, ISO_WITH_OFFSET)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c.isNotNull() & ~F.isnan(c), F.format_string(SIX_DECIMALS, c.cast("double")))
        columns.append(c.alias(f.name))
    return df.select(*columns)


def write_contract_csv(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    writer = contract_text(df).write.mode("errorifexists").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Strict JSON lines: missing metrics are written as null, never as NaN."""
    non_finite_to_null(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_snapshot(
    rows: DataFrame,
    root: str,
    *,
    dataset_id: str,
    source_name: str,
    acquired_at: datetime,
    parameters: Mapping[str, str | int] | None = None,
) -> DataFrame:
    """Immutable raw snapshot with its manifest.

    The folder carries the acquisition date and the head of the content digest and is never
    overwritten. Returns the one-row manifest, which is also written next to the data.
    """
    clean = non_finite_to_null(rows)
    digest = content_digest(clean).first()
    folder = f"{root.rstrip('/')}/{dataset_id}/{acquired_at:%Y-%m-%d}/{digest['sha256'][:12]}"
    clean.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/rows")
    shown = {str(k): str(v) for k, v in (parameters or {}).items()}
    manifest = rows.sparkSession.createDataFrame(
        [(dataset_id, source_name, acquired_at.isoformat(), digest["rows"], digest["sha256"], f"{folder}/rows", shown)],
        "dataset_id string, source_name string, acquired_at string, record_count bigint, "
        "sha256 string, path string, request_parameters map<string,string>",
    )
    manifest.write.mode("errorifexists").json(f"{folder}/manifest")
    return manifest
