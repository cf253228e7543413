"""Regular grids: last value per step, completion, bounded gap filling, time-ordered split."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite
from tidemark.functions.timeline import aligned_index, step_micros, step_start, zone_shift
from tidemark.operators.blocks import (
    BLOCK,
    CORE,
    DEFAULT_BLOCK_STEPS,
    KEYS,
    block_window,
    drop_margin,
    spread_steps,
    with_margin,
)

SOURCE_COLUMNS = ("source_record_id", "station_code", "station_name", "quality_flag")
SEGMENTS = ("train", "validation", "test")
IMPUTED_FLAG = "imputed"
MIN_SPLIT_ROWS = 7


def _payload(obs: DataFrame) -> tuple[Column, Column]:
    """The columns that travel with the winning row, and the order that picks it."""
    present = set(obs.columns)
    carried = [
        (F.col(c) if c in present else F.lit(None)).cast("string").alias(c) for c in SOURCE_COLUMNS
    ]
    seen = F.struct(finite(F.col("water_level_m")).alias("water_level_m"), *carried)
    ties = [c for c in ("row_position", "source_record_id") if c in present][:1]
    return seen, F.struct(F.col("observed_at"), *[F.col(c) for c in ties])


def bucket_last(obs: DataFrame, step: str = "1h", keys: Sequence[str] = KEYS) -> DataFrame:
    """Last observation of every non-empty step (left-closed, labelled by its left edge).

    A value can be up to one step later than its label: a bounded look-ahead that is part of
    the definition. ``max_by`` combines before the shuffle, so a step or series that holds
    most rows does not gather them in one task.
    """
    width = step_micros(step)
    shift = zone_shift(obs.sparkSession, width)
    seen, rank = _payload(obs)
    return (
        obs.select(*keys, aligned_index(obs.sparkSession, F.col("observed_at"), width, shift).alias("_step"),
                   seen.alias("_seen"), rank.alias("_rank"))
        .groupBy(*keys, "_step")
        .agg(F.max_by("_seen", "_rank").alias("_seen"))
        .select(*keys, step_start(F.col("_step"), width, shift).alias("observed_at"), "_seen.*")
    )


def margined_grid(
    obs: DataFrame,
    step: str,
    keys: Sequence[str],
    before: int,
    after: int,
    block_steps: int = DEFAULT_BLOCK_STEPS,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Complete grid rows cut into blocks, each block with its margin rows.

    The reduced observations and the empty steps of each series meet in the one exchange by
    (keys, block) that the later windows use anyway. There an empty step takes over the
    values of the observation sorted right before it: no join and no second sort.
    ``enrich`` may add columns to the empty steps (keys, ``observed_at``) beforehand.
    """
    width = step_micros(step)
    shift = zone_shift(obs.sparkSession, width)
    seen, rank = _payload(obs)
    index = aligned_index(obs.sparkSession, F.col("observed_at"), width, shift)
    reduced = (
        obs.select(*keys, index.alias("_step"), seen.alias("_seen"), rank.alias("_rank"))
        .groupBy(*keys, "_step")
        .agg(F.max_by("_seen", "_rank").alias("_seen"))
    )
    # From the reduced rows, whose exchange is reused: the source is read once.
    bounds = reduced.groupBy(*keys).agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    steps = spread_steps(bounds, keys, "_lo", "_hi", "_step", block_steps).select(
        *keys,
        "_step",
        F.lit(1).alias("_empty"),
        (F.col("_step") - F.col("_lo")).alias("grid_pos"),
        (F.col("_hi") - F.col("_lo") + F.lit(1)).alias("grid_len"),
    )
    # The time follows from the step, so it is not sent unless ``enrich`` needs it.
    start = {"observed_at": step_start(F.col("_step"), width, shift)}
    if enrich is not None:
        steps = enrich(steps.withColumns(start))
    rows = reduced.withColumn("_empty", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    margined = with_margin(rows, "_step", before, after, block_steps)
    window = block_window(keys, "_step", "_empty")
    same = F.lag("_step").over(window) == F.col("_step")
    return (
        margined.withColumn("_seen", F.when(same, F.lag("_seen").over(window)))
        .filter(F.col("_empty") == 1)
        .withColumns({**(start if enrich is None else {}), **{c: F.col(f"_seen.{c}") for c in ("water_level_m", *SOURCE_COLUMNS)}})
        .drop("_seen", "_empty")
    )


def complete_grid(
    obs: DataFrame,
    step: str = "1h",
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """One row per step between the first and last step of each series.

    ``grid_pos``/``grid_len`` make every later position (split, segment bounds, lag reach)
    plain arithmetic.
    """
    return drop_margin(margined_grid(obs, step, keys, 0, 0, block_steps)).drop("_step")


def window_order(margined: DataFrame) -> str:
    """Ordering column of a margined frame.

    A frame straight from ``margined_grid`` is sorted by its step index, and ordering by it
    again costs nothing; a frame cut from a stored grid is ordered by position.
    """
    return "_step" if "_step" in margined.columns else "grid_pos"


def with_nearest(
    margined: DataFrame,
    keys: Sequence[str],
    order: str = "grid_pos",
    level: str = "water_level_m",
    position: str = "grid_pos",
) -> DataFrame:
    """Add ``_left`` and ``_right``: position and level of the nearest observed rows of the block.

    Both are taken in one order, so the block is sorted once, and a row costs the same however far they are.
    """
    seen = F.when(F.col(level).isNotNull(), F.struct(F.col(position).alias("p"), F.col(level).alias("v")))
    by = ", ".join(f"`{c}`" for c in (*keys, BLOCK))
    near = lambda side: F.expr(f"{side}(_here, 1) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `{order}`)")
    return margined.withColumn("_here", seen).withColumns({"_left": near("lag"), "_right": near("lead")}).drop("_here")


def interpolated(max_steps: Column, level: str = "water_level_m", position: str = "grid_pos") -> Column:
    """Linear value inside a run of at most ``max_steps`` missing rows, otherwise NULL."""
    run = F.col("_right.p") - F.col("_left.p") - F.lit(1)
    slope = (F.col("_right.v") - F.col("_left.v")) / (F.col("_right.p") - F.col("_left.p"))
    value = slope * (F.col(position) - F.col("_left.p")) + F.col("_left.v")
    return F.when(F.col(level).isNull() & (run <= max_steps), value)


def fill_margined(margined: DataFrame, max_steps: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fill short inner gaps inside blocks that already carry their margin rows."""
    if max_steps == 0:
        return margined.withColumn("is_imputed", F.lit(False))
    return (
        with_nearest(margined, keys, window_order(margined))
        .withColumn("_fill", interpolated(F.lit(max_steps)))
        .withColumn("is_imputed", F.col("_fill").isNotNull())
        .withColumn("water_level_m", F.coalesce("water_level_m", "_fill"))
        .withColumn(
            "quality_flag",
            F.when(F.col("is_imputed"), F.lit(IMPUTED_FLAG)).otherwise(F.col("quality_flag")),
        )
        .drop("_left", "_right", "_fill")
    )


def checked_steps(max_steps: int) -> int:
    if isinstance(max_steps, bool) or not isinstance(max_steps, int) or max_steps < 0:
        raise ValueError(f"max_steps must be a non-negative integer, got {max_steps!r}")
    return max_steps


def fill_short_gaps(
    grid: DataFrame,
    max_steps: int,
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Linear fill of inner runs of at most ``max_steps`` missing rows; edges stay missing."""
    steps = checked_steps(max_steps)
    if steps == 0:
        return grid.withColumn("is_imputed", F.lit(False))
    margined = with_margin(grid, "grid_pos", steps, steps, max(block_steps, steps))
    return drop_margin(fill_margined(margined, steps, keys))


def resample(
    obs: DataFrame,
    step: str = "1h",
    *,
    max_steps: int,
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Observations to a regular grid with short gaps filled and imputation marked."""
    steps = checked_steps(max_steps)
    margined = margined_grid(obs, step, keys, steps, steps, max(block_steps, steps))
    return drop_margin(fill_margined(margined, steps, keys)).drop("_step")


def split_sizes(length: Column, train: float, validation: float) -> tuple[Column, Column]:
    """Row counts of the first two segments: floors of the shares of the series length."""
    return (
        F.floor(length * F.lit(float(train))).cast("long"),
        F.floor(length * F.lit(float(validation))).cast("long"),
    )


def checked_ratios(train: float, validation: float) -> None:
    for name, value in (("train", train), ("validation", validation)):
        if isinstance(value, bool) or not 0.0 < float(value) < 1.0:
            raise ValueError(f"{name} must be strictly between 0 and 1, got {value!r}")
    if train + validation >= 1.0:
        raise ValueError(f"train + validation must be below 1, got {train + validation!r}")


def chronological_split(
    grid: DataFrame, train: float = 0.70, validation: float = 0.15
) -> DataFrame:
    """Add ``segment`` and the segment's bounds (``seg_first``, ``seg_last`` positions).

    Works on the position and length columns of the grid, so no sort and no shuffle. A
    series that is too short or would get an empty segment has a NULL segment; it is listed
    by ``unsplittable_series`` and refused by ``require_splittable``.
    """
    checked_ratios(train, validation)
    first, second = split_sizes(F.col("grid_len"), train, validation)
    rest = F.col("grid_len") - first - second
    splittable = (F.col("grid_len") >= MIN_SPLIT_ROWS) & (F.least(first, second, rest) > 0)
    # The cuts are columns of their own, and every later choice is an array lookup by part
    # number: nested conditions over conditions would be multiplied by the optimizer.
    cut = grid.withColumn(
        "_cuts",
        F.when(splittable, F.array(F.lit(0).cast("long"), first, first + second, F.col("grid_len"))),
    )
    # ``get`` is NULL for a missing array; ``element_at`` promises a value and must not be used.
    part = (F.col("grid_pos") >= F.get("_cuts", F.lit(1))).cast("int") + (
        F.col("grid_pos") >= F.get("_cuts", F.lit(2))
    ).cast("int")
    return (
        cut.withColumn("_part", part)
        .withColumns(
            {
                "segment": F.get(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("_part")),
                "seg_first": F.get("_cuts", F.col("_part")),
                "seg_last": F.get("_cuts", F.col("_part") + 1) - F.lit(1),
            }
        )
        .drop("_cuts", "_part")
    )


def unsplittable_series(split: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Series that cannot be cut into three non-empty segments."""
    return (
        split.filter(F.col("segment").isNull())
        .groupBy(*keys)
        .agg(F.max("grid_len").alias("grid_len"))
    )


def require_splittable(split: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fail when any series is too short; reads one row at most."""
    bad = unsplittable_series(split, keys).take(1)
    if bad:
        raise ValueError(
            f"chronological split needs at least {MIN_SPLIT_ROWS} rows and three non-empty "
            f"segments; failing series: {bad[0].asDict()}"
        )
    return split


def with_grid_position(
    grid: DataFrame, step: str = "1h", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Restore ``grid_pos``/``grid_len`` on a stored grid that does not carry them."""
    if {"grid_pos", "grid_len"} <= set(grid.columns):
        return grid
    width = step_micros(step)
    shift = zone_shift(grid.sparkSession, width)
    index = aligned_index(grid.sparkSession, F.col("observed_at"), width, shift)
    bounds = grid.select(*keys, index.alias("_step")).groupBy(*keys).agg(
        F.min("_step").alias("_lo"), F.max("_step").alias("_hi")
    )
    return (
        grid.withColumn("_step", index)
        .join(bounds, list(keys))
        .withColumn("grid_pos", F.col("_step") - F.col("_lo"))
        .withColumn("grid_len", F.col("_hi") - F.col("_lo") + F.lit(1))
        .drop("_step", "_lo", "_hi")
    )


def interpolation_sweep(
    grid: DataFrame,
    candidates: Sequence[int] = (0, 1, 2, 3, 6),
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Effect of each fill threshold on imputed, missing and usable rows.

    ``grid`` is the unfilled grid. Its neighbours say of each row the least threshold under which it is present; a pair of
    rows is usable from the larger of theirs on, so the grid is neither copied nor windowed again per candidate. Only
    whether a row is observed is sent, not its level.
    """
    widest = max(candidates)
    reach = max(horizons)
    slim = grid.select(*keys, "grid_pos", F.col("water_level_m").isNotNull().alias("_seen"))
    margined = with_margin(slim, "grid_pos", widest, widest + reach, max(block_steps, widest + reach))
    by = ", ".join(f"`{c}`" for c in (*keys, BLOCK))
    near = lambda side: F.expr(f"{side}(IF(_seen, grid_pos, NULL), 1) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `grid_pos`)")
    never = F.lit(widest + 1)
    run = F.col("_right") - F.col("_left") - F.lit(1)
    needs = F.when(F.col("_seen"), F.lit(0)).when(run <= widest, run.cast("int")).otherwise(never)
    window = block_window(keys, "grid_pos")
    both = lambda h: F.greatest("_needs", F.coalesce(F.lead("_needs", h).over(window), never))
    known = margined.withColumns({"_left": near("lag"), "_right": near("lead")}).withColumn("_needs", needs)
    paired = known.select(
        *keys, CORE, "_seen", "_needs", *[both(h).alias(f"_both_{h}") for h in horizons]
    )
    sums = [F.count("*").alias("rows")]
    for n in candidates:
        sums.append(F.count_if((F.col("_needs") <= n) & ~F.col("_seen")).alias(f"imputed_{n}"))
        sums.append(F.count_if(F.col("_needs") > n).alias(f"missing_{n}"))
        sums.extend(F.count_if(F.col(f"_both_{h}") <= n).alias(f"usable_{n}_{h}") for h in horizons)
    totals = paired.filter(F.col(CORE)).groupBy(*keys).agg(*sums)
    lines = F.array(
        *[
            F.struct(
                F.lit(n).alias("max_steps"),
                F.col("rows"),
                F.col(f"imputed_{n}").alias("imputed_rows"),
                F.round(F.col(f"imputed_{n}") / F.col("rows"), 6).alias("imputed_rate"),
                F.col(f"missing_{n}").alias("remaining_missing"),
                *[F.col(f"usable_{n}_{h}").alias(f"usable_h{h}") for h in horizons],
            )
            for n in candidates
        ]
    )
    return totals.select(*keys, F.inline(lines))
