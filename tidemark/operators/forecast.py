"""Persistence and constant forecasts, as-of lookups and the serving choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite
from tidemark.functions.timeline import shift_steps, step_micros
from tidemark.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    CORE,
    DEFAULT_BLOCK_STEPS,
    KEYS,
    block_window,
    equal_blocks,
    with_margin,
)

PERSISTENCE = "persistence"
TRAIN_MEAN = "train_mean"
DAY_US = 86_400_000_000

# Status names from best to worst.
STATUS_ORDER = ("ok", "degraded", "unavailable")


def checked_horizons(horizons: Sequence[int]) -> tuple[int, ...]:
    """Positive horizons, de-duplicated and sorted."""
    if not horizons or any(isinstance(h, bool) or not isinstance(h, int) or h <= 0 for h in horizons):
        raise ValueError(f"horizons must be positive integers, got {tuple(horizons)!r}")
    return tuple(sorted(set(horizons)))


def persistence_forecasts(
    split: DataFrame,
    horizons: Sequence[int] = (1, 3, 6),
    step: str = "1h",
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Long forecasts ``prediction(t) = level(t - h)`` on the full series, then segmented.

    A segment's first rows may therefore use the tail of the segment before; this sample set
    differs on purpose from the in-segment ``usable_h`` rows of the feature matrix.
    """
    return persistence_lines(lagged_levels(split, horizons, keys, block_steps), horizons, step, keys)


def lagged_levels(
    split: DataFrame,
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Each grid row with the level ``h`` steps before, ``_p<h>``, for every horizon."""
    steps = checked_horizons(horizons)
    slim = split.select(*keys, "segment", "grid_pos", "observed_at", "water_level_m", "is_imputed")
    margined = with_margin(slim, "grid_pos", max(steps), 0, max(block_steps, max(steps))).drop("grid_pos")
    # Times ascend with the positions, so only one of them is sent.
    window = block_window(keys, "observed_at")
    lagged = margined.withColumns(
        {f"_p{h}": F.lag("water_level_m", h).over(window) for h in steps}
    ).filter(F.col(CORE))
    return lagged.drop(BLOCK, CORE)


def persistence_lines(
    lagged: DataFrame, horizons: Sequence[int] = (1, 3, 6), step: str = "1h", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Long forecasts from the rows of ``lagged_levels``."""
    steps = checked_horizons(horizons)
    width = step_micros(step)
    lines = F.array(
        *[F.struct(F.lit(h).alias("horizon"), F.col(f"_p{h}").alias("prediction")) for h in steps]
    )
    return lagged.select(
        *keys,
        F.lit(PERSISTENCE).alias("model"),
        "segment",
        F.col("observed_at").alias("target"),
        F.col("water_level_m").alias("observed"),
        "is_imputed",
        F.inline(lines),
    ).select(
        *keys, "model", "horizon", "segment",
        shift_steps(F.col("target"), -F.col("horizon"), width).alias("anchor"),
        "target", "observed", "prediction", "is_imputed",
    )


def scored_rows(forecasts: DataFrame) -> DataFrame:
    """Rows that enter a score: finite pair, target not imputed."""
    kept = finite(F.col("observed")).isNotNull() & finite(F.col("prediction")).isNotNull()
    if "is_imputed" in forecasts.columns:
        kept = kept & ~F.col("is_imputed")
    return forecasts.filter(kept)


def train_means(split: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the observed, non-imputed train levels per series."""
    usable = (F.col("segment") == "train") & ~F.col("is_imputed")
    return split.groupBy(*keys).agg(
        F.avg(F.when(usable, finite(F.col("water_level_m")))).alias("train_mean"),
        F.count(F.when(usable, finite(F.col("water_level_m")))).alias("fit_rows"),
    )


def constant_forecasts(
    persistence: DataFrame, means: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The train mean on exactly the rows where persistence has a prediction."""
    value = F.when(F.col("prediction").isNotNull(), F.col("train_mean"))
    return (
        persistence.join(means.select(*keys, "train_mean"), list(keys), "left")
        .withColumn("prediction", value)
        .withColumn("model", F.lit(TRAIN_MEAN))
        .drop("train_mean")
        .select(*persistence.columns)
    )


def _ties(obs: DataFrame) -> list[str]:
    """What decides between readings of one moment: the later row, the larger id, the higher level."""
    return [c for c in ("row_position", "source_record_id", "water_level_m") if c in obs.columns]


def latest_before(
    obs: DataFrame, as_of: object = None, keys: Sequence[str] = KEYS, n: int = 1
) -> DataFrame:
    """Latest observation (or the last ``n``) per series at or before one moment.

    ``n = 1`` is a combining aggregate; for more, the rank filter becomes a per-partition
    group limit before the shuffle.
    """
    seen = obs.filter(finite(F.col("water_level_m")).isNotNull())
    if as_of is not None:
        seen = seen.filter(F.col("observed_at") <= F.lit(as_of))
    if n == 1:
        return seen.groupBy(*keys).agg(
            F.max("observed_at").alias("observed_at"),
            F.max_by("water_level_m", F.struct("observed_at", *_ties(seen))).alias("water_level_m"),
        )
    order = Window.partitionBy(*keys).orderBy(F.col("observed_at").desc(), *[F.col(c).desc() for c in _ties(seen)])
    ranked = seen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    return ranked.drop("_rank")


def asof_join(
    requests: DataFrame,
    obs: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    at: str = "as_of",
    time: str = "observed_at",
    values: Sequence[str] = ("water_level_m",),
    block_us: int = DAY_US,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each request with the latest observation of its series at or before its time.

    The distinct request times and the observations are ordered together inside (keys, time
    block) of bounded rows; a time without an observation earlier in its block takes the last one of the
    blocks before, from a table with one row per block. The answers are then joined back to
    the requests, so many requests for one moment do not pile up in one window group. Of
    observations of one moment the one with the largest ``values`` is taken, compared in their order.
    """
    found = F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in values])
    right = obs.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), found.alias("_seen"))
    moments = requests.select(*keys, F.col(at).alias("_t")).distinct().withColumn("_side", F.lit(1))
    both = right.unionByName(moments, allowMissingColumns=True).filter(F.col("_t").isNotNull())
    rows = (
        equal_blocks(both, keys, "_t", block_us, block_rows)
        # Stated before the exchange: the joins below infer it on one side only.
        .filter(F.col(BLOCK).isNotNull())
        .repartition(*keys, BLOCK)
    )
    window = block_window(keys, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = (
        rows.withColumn("_here", F.max("_seen").over(window))
        .filter(F.col("_side") == 1)
        .select(*keys, BLOCK, "_t", "_here")
    )
    last = rows.groupBy(*keys, BLOCK).agg(
        F.max("_seen").alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        *keys, BLOCK, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    hit = F.coalesce("_here", "_carried")
    answers = local.join(carried, [*keys, BLOCK]).select(*keys, F.col("_t").alias(at), hit.alias("_hit"))
    return requests.join(answers, [*keys, at], "left").select(
        *requests.columns, F.col("_hit.t").alias(time), *[F.col(f"_hit.{v}").alias(v) for v in values]
    )


def artifact_points(artifacts: DataFrame, as_of: object, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stored prediction points that may be used at ``as_of``.

    ``artifacts``: keys, model, model_version, as_of, anchor_at, priority, points. The first
    candidate by ``priority`` that is not newer than ``as_of`` and holds the horizon wins,
    even when a later candidate is more recent.
    """
    usable = artifacts.filter(F.col("as_of") <= F.lit(as_of)).select(
        *keys, "model", "model_version", "as_of", "anchor_at", "priority", F.inline("points")
    )
    columns = F.struct("model_version", "as_of", "anchor_at", "target_at", "water_level_m")
    return (
        usable.groupBy(*keys, "model", "horizon")
        .agg(F.min_by(columns, "priority").alias("_p"))
        .select(*keys, "model", "horizon", "_p.*")
    )


def served_persistence(
    latest: DataFrame, as_of: Column, horizons: Sequence[int], step: str, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Persistence points issued at ``as_of`` from the latest level of each series."""
    steps = F.explode(F.array(*[F.lit(h) for h in checked_horizons(horizons)]))
    rows = latest.withColumn("horizon", steps)
    return rows.select(
        *keys,
        "horizon",
        F.col("observed_at").alias("anchor_at"),
        shift_steps(as_of, F.col("horizon"), step_micros(step)).alias("target_at"),
        F.col("water_level_m").alias("persistence_value"),
    )


def choose_forecasts(
    persistence: DataFrame,
    model_points: DataFrame,
    requested_model: str,
    horizons: Sequence[int],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The model's points when **all** horizons are there, otherwise persistence.

    Falling back from a requested model is ``degraded``; a series whose points are all
    missing is ``unavailable``.
    """
    steps = checked_horizons(horizons)
    points = model_points.filter(
        (F.col("model") == requested_model) & F.col("horizon").isin(*steps)
    ).select(*keys, "horizon", F.struct("model_version", F.col("water_level_m").alias("value")).alias("_m"))
    joined = persistence.join(points, [*keys, "horizon"], "left")
    # One row per horizon and series: the group is as long as the horizon list.
    series = Window.partitionBy(*keys)
    complete = F.count("_m").over(series) == F.lit(len(steps))
    value = F.when(F.col("_complete"), F.col("_m.value")).otherwise(F.col("persistence_value"))
    fallback = ~F.col("_complete") & F.lit(requested_model != PERSISTENCE)
    return (
        joined.withColumn("_complete", complete)
        .withColumn("water_level_m", value)
        .withColumn("_known", F.count("water_level_m").over(series))
        .withColumn(
            "status",
            F.when(~F.col("_complete") & (F.col("_known") == 0), F.lit("unavailable"))
            .when(fallback, F.lit("degraded"))
            .otherwise(F.lit("ok")),
        )
        .withColumn(
            "fallback_reason",
            F.when(F.col("status") == "unavailable", F.lit("insufficient_history")).when(
                fallback, F.lit("model_artifact_unavailable")
            ),
        )
        .select(
            *keys,
            "horizon",
            "anchor_at",
            "target_at",
            "water_level_m",
            F.when(F.col("_complete"), F.lit(requested_model)).otherwise(F.lit(PERSISTENCE)).alias("model"),
            F.when(F.col("_complete"), F.col("_m.model_version")).alias("model_version"),
            "status",
            "fallback_reason",
        )
    )


def worst_status(status: Column) -> Column:
    """Aggregate: the worst of several status values."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
    return F.get(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.max(rank).cast("int") - 1)
