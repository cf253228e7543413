"""Deterministic risk levels from multi-horizon forecasts, and the station bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite
from tidemark.functions.timeline import age_minutes, freshness
from tidemark.operators.blocks import KEYS
from tidemark.operators.forecast import checked_horizons, worst_status

# The rule's horizons and default budget.
ELEVATED_HORIZON = 1
WATCH_HORIZONS = (3, 6)
DEFAULT_HORIZONS = (1, 3, 6)
STALE_AFTER_HOURS = 3.0


def forecast_maps(points: DataFrame, keys: Sequence[str] = KEYS, value: str = "water_level_m") -> DataFrame:
    """Long points to one ``predictions`` map per series (as long as the horizon list)."""
    entry = F.struct(F.col("horizon").cast("int"), finite(F.col(value)))
    return points.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("predictions"))


def risk_levels(
    requests: DataFrame,
    *,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    stale_after_hours: float = STALE_AFTER_HOURS,
) -> DataFrame:
    """Add ``level``, ``triggered_horizons``, ``missing_horizons``, ``data_age_hours``, ``is_stale``.

    Needs ``predictions`` (map of horizon to level), ``threshold``, ``anchor_at`` and
    ``last_observed_at``. Missing horizons never trigger but are listed; staleness only
    flags. Rows without any finite prediction get a NULL level.
    """
    steps = checked_horizons(horizons)
    wanted = F.array(*[F.lit(h) for h in steps])
    value = lambda h: finite(F.try_element_at(F.col("predictions"), h))
    triggered = F.filter(wanted, lambda h: F.coalesce(value(h) >= F.col("threshold"), F.lit(False)))
    missing = F.filter(wanted, lambda h: value(h).isNull())
    hit = F.col("triggered_horizons")
    age = (
        F.unix_micros(F.col("anchor_at").cast("timestamp"))
        - F.unix_micros(F.col("last_observed_at").cast("timestamp"))
    ) / F.lit(3.6e9)
    level = F.when(F.size("missing_horizons") == len(steps), F.lit(None).cast("string"))
    if ELEVATED_HORIZON in steps:
        level = level.when(F.array_contains(hit, ELEVATED_HORIZON), F.lit("elevated"))
    watch = [h for h in WATCH_HORIZONS if h in steps]
    if watch:
        level = level.when(
            F.arrays_overlap(hit, F.array(*[F.lit(h) for h in watch])), F.lit("watch")
        )
    return (
        requests.withColumn("triggered_horizons", triggered)
        .withColumn("missing_horizons", missing)
        .withColumn("level", level.otherwise(F.lit("normal")))
        .withColumn("data_age_hours", F.bround(age, 6))
        .withColumn("is_stale", age > F.lit(float(stale_after_hours)))
    )


def request_rules() -> dict[str, Column]:
    """A rule is true for a request that must be refused."""
    return {
        "bad_threshold": ~F.coalesce(finite(F.col("threshold")) > 0, F.lit(False)),
        "observed_after_anchor": F.col("last_observed_at") > F.col("anchor_at"),
        "no_finite_prediction": ~F.exists(
            F.map_values("predictions"), lambda v: finite(v).isNotNull()
        ),
    }


def with_freshness(latest: DataFrame, as_of: Column, stale_after_minutes: float) -> DataFrame:
    """Age of the latest observation at ``as_of`` and whether it is stale."""
    age = age_minutes(as_of, F.col("observed_at"))
    return latest.withColumn("data_age_minutes", age).withColumn(
        "freshness", freshness(age, stale_after_minutes)
    )


def station_bundle(
    latest: DataFrame,
    points: DataFrame,
    thresholds: DataFrame,
    comparison: DataFrame | None = None,
    *,
    as_of: Column | None = None,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    stale_after_minutes: float = 180.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per series: latest observation, forecast map, risk and comparison.

    Each side is reduced to one row per series first, so the joins move one row per station.
    """
    on = list(keys)
    moment = as_of if as_of is not None else F.col("observed_at")
    known = with_freshness(latest, moment, stale_after_minutes)
    maps = points.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("horizon").cast("int"), finite(F.col("water_level_m"))))
        ).alias("predictions"),
        F.max("model").alias("model"),
        worst_status(F.col("status")).alias("status"),
        F.max("fallback_reason").alias("fallback_reason"),
    )
    joined = (
        known.join(maps, on, "left")
        .join(thresholds.select(*keys, "threshold"), on, "left")
        .withColumn("generated_at", moment)
        .withColumn("anchor_at", moment)
        .withColumn("last_observed_at", F.col("observed_at"))
        .withColumn(
            "status",
            F.when((F.col("status") == "ok") & (F.col("freshness") == "stale"), F.lit("degraded"))
            .otherwise(F.col("status")),
        )
    )
    judged = risk_levels(joined, horizons=horizons, stale_after_hours=stale_after_minutes / 60.0)
    if comparison is not None:
        judged = judged.join(comparison, on, "left")
    return judged.drop("anchor_at", "last_observed_at")
