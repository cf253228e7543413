"""Raw text records to observations, with every rejected row counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite
from tidemark.functions.text import (
    date_only,
    iso_text,
    level_state,
    level_value,
    optional_text,
    record_id,
    with_timestamp,
)
from tidemark.operators.blocks import KEYS

# The keys of a raw record.
RAW_KEYS = ("z_id", "time_d", "up_water_level")
NORMAL_FLAG = "normal"


def map_headers(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename mapped headers (blanks and quotes trimmed), drop the rest, require the raw keys."""
    pairs = [(c, mapping.get(c.strip().strip('"').strip())) for c in df.columns]
    internal = [c for c in df.columns if c.startswith("_")]
    found = {target for _, target in pairs if target}
    missing = [k for k in RAW_KEYS if k not in found]
    if missing:
        raise ValueError(f"missing required column(s) after mapping: {', '.join(missing)}")
    return df.select(
        *[F.col(f"`{source}`").alias(target) for source, target in pairs if target], *internal
    )


def last_occurrence(
    raw: DataFrame, position: Column, keys: Sequence[str] = (), id_column: str = "z_id"
) -> DataFrame:
    """Keep the last row of every non-blank id *before* any validation.

    A blank reading can therefore win. Rows without an id all pass. The winner is picked by
    a combining aggregate, so an id repeated in a third of the rows is reduced before the
    shuffle instead of being sorted in one task.
    """
    ident = optional_text(F.col(id_column))
    columns = raw.columns
    named = raw.filter(ident.isNotNull()).select(
        *keys, ident.alias("_id"), F.struct(*columns).alias("_row"), position.alias("_at")
    )
    winners = (
        named.groupBy(*keys, "_id").agg(F.max_by("_row", "_at").alias("_row")).select("_row.*")
    )
    return winners.unionByName(raw.filter(ident.isNull()))


def archive_counts(rows: DataFrame, member: str = "_member", id_column: str = "z_id") -> DataFrame:
    """Rows per archive member, and one total row (NULL member) with unique and duplicate rows.

    A row without an id is unique by definition.
    """
    ident = optional_text(F.col(id_column))
    per_id = rows.groupBy(member, ident.alias("_id")).agg(F.count("*").alias("_n"))
    members = per_id.groupBy(member).agg(F.sum("_n").alias("rows"))
    once = F.when(F.col("_id").isNull(), F.col("_n")).otherwise(F.lit(1))
    total = per_id.groupBy("_id").agg(F.sum("_n").alias("_n")).agg(
        F.lit(None).cast("string").alias(member),
        F.sum("_n").alias("rows"),
        F.sum(once).alias("unique_rows"),
        (F.sum("_n") - F.sum(once)).alias("duplicate_rows"),
    )
    return members.unionByName(total, allowMissingColumns=True)


def classify_rows(raw: DataFrame, *, numeric_id: bool = False) -> DataFrame:
    """Typed columns plus ``reject_reason``, checked in the fixed order id, time, level."""
    present = set(raw.columns)
    optional = {
        name: optional_text(F.col(name)) if name in present else F.lit(None).cast("string")
        for name in ("station_code", "station_name")
    }
    typed = with_timestamp(raw, "time_d", "observed_at").withColumns(
        {
            "source_record_id": record_id(F.col("z_id"), numeric_source=numeric_id),
            "water_level_m": level_value(F.col("up_water_level")),
            "_state": level_state(F.col("up_water_level")),
            **optional,
        }
    )
    state = F.col("_state")
    reason = (
        F.when(F.col("source_record_id").isNull(), F.lit("invalid_timestamp"))
        .when(F.col("observed_at").isNull(), F.lit("invalid_timestamp"))
        .when(state == "missing", F.lit("missing_level"))
        .when(state == "invalid", F.lit("invalid_level"))
    )
    return typed.withColumn("reject_reason", reason).drop("_state")


def audit_ids(
    raw: DataFrame,
    position: Column,
    keys: Sequence[str] = KEYS,
    *,
    numeric_id: bool = False,
) -> DataFrame:
    """One row per (series, id): its last valid row and its counters, from one pass.

    Both the observations and the audit counters are read off this table. Rejected rows have
    no rank, so they cannot win; an id that fills a third of the input is combined before
    the shuffle.
    """
    columns = ("observed_at", "water_level_m", "station_code", "station_name")
    accepted = F.col("reject_reason").isNull()
    return (
        classify_rows(raw, numeric_id=numeric_id)
        .groupBy(*keys, "source_record_id")
        .agg(
            F.max_by(F.struct(*columns), F.when(accepted, position)).alias("kept"),
            F.count("*").alias("rows"),
            F.count_if(accepted).alias("accepted_rows"),
            *[
                F.count_if(F.coalesce(F.col("reject_reason") == reason, F.lit(False))).alias(f"{reason}_rows")
                for reason in ("invalid_timestamp", "invalid_level", "missing_level")
            ],
            F.count_if(date_only(F.col("time_d"))).alias("date_only_rows"),
        )
    )


def audited_observations(audit: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The valid observations of an audit table."""
    return audit.filter(F.col("kept").isNotNull()).select(
        *keys, "source_record_id", "kept.*", F.lit(NORMAL_FLAG).alias("quality_flag")
    )


def audited_counts(audit: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Audit counters per series, including the conservation identity."""
    summary = audit.groupBy(*keys).agg(
        F.sum("rows").alias("total_rows"),
        F.count_if(F.col("accepted_rows") > 0).alias("valid_rows"),
        F.sum(F.greatest(F.col("accepted_rows") - 1, F.lit(0))).alias("duplicate_rows"),
        F.sum("invalid_timestamp_rows").alias("invalid_timestamp_rows"),
        F.sum("invalid_level_rows").alias("invalid_level_rows"),
        F.sum("missing_level_rows").alias("missing_level_rows"),
        F.sum("date_only_rows").alias("date_only_rows"),
        F.min("kept.observed_at").alias("start_at"),
        F.max("kept.observed_at").alias("end_at"),
    )
    return with_conservation(summary)


def normalise(
    raw: DataFrame,
    position: Column,
    keys: Sequence[str] = KEYS,
    *,
    numeric_id: bool = False,
) -> DataFrame:
    """Valid observations; a repeated id keeps its last *valid* row by input position."""
    return audited_observations(audit_ids(raw, position, keys, numeric_id=numeric_id), keys)


def sorted_observations(obs: DataFrame) -> DataFrame:
    """Output order: time, then id. Only for writing; no operator relies on it."""
    return obs.orderBy("observed_at", "source_record_id")


def reject_counts(
    raw: DataFrame,
    position: Column,
    keys: Sequence[str] = KEYS,
    *,
    numeric_id: bool = False,
) -> DataFrame:
    """Audit counters per series straight from raw records."""
    return audited_counts(audit_ids(raw, position, keys, numeric_id=numeric_id), keys)


def with_conservation(summary: DataFrame) -> DataFrame:
    """``conserved``: total equals valid plus the four reject counters."""
    parts = (
        F.col("valid_rows")
        + F.col("duplicate_rows")
        + F.col("invalid_timestamp_rows")
        + F.col("invalid_level_rows")
        + F.col("missing_level_rows")
    )
    return summary.withColumn("conserved", F.col("total_rows") == parts)


def latest_per_stamp(
    rows: DataFrame, position: Column, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Coerced rows, unusable ones dropped, one row per timestamp (the last by position)."""
    usable = rows.select(
        *keys,
        F.try_to_timestamp(iso_text(F.col("time_d").cast("string"))).alias("observed_at"),
        finite(F.col("up_water_level").try_cast("double")).alias("_level"),
        position.alias("_at"),
    ).filter(F.col("observed_at").isNotNull() & F.col("_level").isNotNull())
    return usable.groupBy(*keys, "observed_at").agg(
        F.max_by("_level", "_at").alias("water_level_m")
    )


def sample_notes(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counters that accompany ``latest_per_stamp``: totals and dropped rows by cause."""
    stamp = F.try_to_timestamp(iso_text(F.col("time_d").cast("string")))
    level = finite(F.col("up_water_level").try_cast("double"))
    usable = stamp.isNotNull() & level.isNotNull()
    per_stamp = rows.groupBy(*keys, stamp.alias("_stamp")).agg(
        F.count("*").alias("_rows"), F.count_if(usable).alias("_ok")
    )
    return per_stamp.groupBy(*keys).agg(
        F.sum("_rows").alias("total_rows"),
        F.count_if(F.col("_ok") > 0).alias("usable_rows"),
        F.coalesce(F.sum(F.when(F.col("_stamp").isNull(), F.col("_rows"))), F.lit(0)).alias(
            "invalid_timestamp_rows"
        ),
        F.coalesce(
            F.sum(F.when(F.col("_stamp").isNotNull(), F.col("_rows") - F.col("_ok"))), F.lit(0)
        ).alias("unusable_level_rows"),
        F.sum(F.greatest(F.col("_ok") - 1, F.lit(0))).alias("duplicate_stamp_rows"),
    )


def in_range(
    obs: DataFrame, start: object = None, end: object = None, column: str = "observed_at"
) -> DataFrame:
    """Closed time range; a plain comparison, so it reaches the Parquet scan."""
    if start is not None and end is not None and start > end:
        raise ValueError(f"inverted range: {start!r} is after {end!r}")
    if start is not None:
        obs = obs.filter(F.col(column) >= F.lit(start))
    if end is not None:
        obs = obs.filter(F.col(column) <= F.lit(end))
    return obs


def select_series(obs: DataFrame, key: str | None = None, column: str = "series_key") -> DataFrame:
    """One series by key; without a key the data must hold exactly one."""
    if key is not None:
        return obs.filter(F.col(column) == key)
    found = [r[0] for r in obs.select(column).distinct().take(2)]
    if len(found) > 1:
        raise ValueError(f"several series present (for example {found}); name one")
    return obs
