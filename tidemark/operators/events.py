"""High-level events: thresholds, runs, detection scores, peaks, leads and phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import direction, finite
from tidemark.functions.timeline import HOUR_US
from tidemark.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    KEYS,
    block_window,
    equal_blocks,
    runs,
    time_block,
    with_previous,
)
from tidemark.operators.metrics import CELL, regression_aggregates
from tidemark.operators.quantiles import exact_quantiles

# Reasons of undefined event numbers.
NO_OBSERVED = "no_observed_events"
NO_PREDICTED = "no_predicted_events"
NO_CROSSING = "no_prediction_above_threshold"
NO_ADVANCE = "crossing_after_event_start"
NO_PAIRS = "no_valid_pairs"

BLOCK_US = 4096 * HOUR_US


def fit_thresholds(
    features: DataFrame, quantile: float = 0.90, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Exact train-only quantile of the observed, non-imputed levels of each series."""
    if not 0.0 < quantile <= 1.0:
        raise ValueError(f"quantile must lie in (0, 1], got {quantile!r}")
    fit = features.filter((F.col("segment") == "train") & ~F.col("is_imputed_t")).select(
        *keys, finite(F.col("water_level_t")).alias("_level")
    )
    return exact_quantiles(fit, "_level", [quantile], keys).select(
        *keys, F.col("value").alias("threshold"), F.col("n").alias("fit_rows")
    )


def above(level: Column, threshold: Column) -> Column:
    """``level >= threshold``; a missing level is never an event."""
    return F.coalesce(finite(level) >= threshold, F.lit(False))


def _usable_levels(features: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    usable = features.filter(finite(F.col("water_level_t")).isNotNull() & ~F.col("is_imputed_t"))
    return usable.select(*keys, "segment", "observed_at", "water_level_t").join(
        thresholds.select(*keys, "threshold"), list(keys)
    )


def event_windows(
    features: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str] = KEYS,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Event runs of the observed grid per series and segment.

    Runs are over the rows that survive filtering, so one run may bridge missing hours.
    """
    rows = _usable_levels(features, thresholds, keys)
    flagged = rows.select(
        *keys, "segment", "observed_at",
        above(F.col("water_level_t"), F.col("threshold")).alias("_event"),
    )
    found = runs(
        flagged, [*keys, "segment"], "observed_at", F.col("_event"),
        time_block(F.col("observed_at"), block_us),
    )
    return found.select(
        *keys,
        "segment",
        F.col("run_start").alias("event_start"),
        F.col("run_end").alias("event_end"),
        F.col("run_length").alias("event_points"),
    )


def event_summary(
    features: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str] = KEYS,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Hours, usable observations, highest level, event points and runs per segment."""
    usable = finite(F.col("water_level_t")).isNotNull() & ~F.col("is_imputed_t")
    level = F.when(usable, F.col("water_level_t"))
    base = (
        features.join(thresholds.select(*keys, "threshold"), list(keys))
        .groupBy(*keys, "segment", "threshold")
        .agg(
            F.count("*").alias("hours"),
            F.count(level).alias("usable_observations"),
            F.max(level).alias("max_level"),
            F.count_if(above(level, F.col("threshold"))).alias("event_points"),
        )
    )
    windows = event_windows(features, thresholds, keys, block_us)
    segments = windows.groupBy(*keys, "segment").agg(F.count("*").alias("event_segments"))
    return base.join(segments, [*keys, "segment"], "left").withColumn(
        "event_segments", F.coalesce("event_segments", F.lit(0))
    )


def event_metrics(
    forecasts: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str] = KEYS,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Point-level precision, recall and F1 with run counts, per cell.

    Run starts are counted inside (cell, block); a block whose first row continues the event
    of the last row before gives one start back. The second step sees one row per block.
    """
    cell = [*keys, *CELL]
    rows = (
        forecasts.join(thresholds.select(*keys, "threshold"), list(keys))
        .select(
            *cell,
            "target",
            above(F.col("observed"), F.col("threshold")).alias("_o"),
            above(F.col("prediction"), F.col("threshold")).alias("_p"),
        )
        .withColumn(BLOCK, time_block(F.col("target"), block_us))
    )
    window = block_window(cell, "target")
    local = rows.withColumns(
        {f"_{s}_before": F.coalesce(F.lag(f"_{s}").over(window), F.lit(False)) for s in "op"}
    )
    hit = F.col("_o") & F.col("_p")
    blocks = local.groupBy(*cell, BLOCK).agg(
        F.count_if(hit).alias("tp"),
        F.count_if(~F.col("_o") & F.col("_p")).alias("fp"),
        F.count_if(F.col("_o") & ~F.col("_p")).alias("fn"),
        *[F.count_if(F.col(f"_{s}") & ~F.col(f"_{s}_before")).alias(f"_{s}_starts") for s in "op"],
        *[F.min_by(f"_{s}", "target").alias(f"_{s}_first") for s in "op"],
        *[F.max_by(f"_{s}", "target").alias(f"_{s}_last") for s in "op"],
    )
    series = Window.partitionBy(*cell).orderBy(BLOCK)
    joined = blocks.withColumns(
        {
            f"_{s}_joins": (
                F.col(f"_{s}_first") & F.coalesce(F.lag(f"_{s}_last").over(series), F.lit(False))
            ).cast("long")
            for s in "op"
        }
    )
    totals = joined.groupBy(*cell).agg(
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"),
        F.sum(F.col("_o_starts") - F.col("_o_joins")).alias("observed_event_segments"),
        F.sum(F.col("_p_starts") - F.col("_p_joins")).alias("predicted_event_segments"),
    )
    observed = F.col("tp") + F.col("fn")
    predicted = F.col("tp") + F.col("fp")
    defined = (observed > 0) & (predicted > 0)
    return totals.select(
        *cell,
        F.when(defined, F.col("tp") / predicted).alias("precision"),
        F.when(defined, F.col("tp") / observed).alias("recall"),
        F.when(defined, F.lit(2.0) * F.col("tp") / (observed + predicted)).alias("f1"),
        "tp",
        "fp",
        "fn",
        observed.alias("observed_event_points"),
        "observed_event_segments",
        predicted.alias("predicted_event_points"),
        "predicted_event_segments",
        F.when(observed == 0, F.lit(NO_OBSERVED))
        .when(predicted == 0, F.lit(NO_PREDICTED))
        .alias("reason"),
    )


def peak_diagnostics(forecasts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Observed peak, prediction there, largest absolute error and signed peak lag.

    The first row wins on ties. The lag takes each series' own peak over its own valid rows.
    """
    obs, pred = finite(F.col("observed")), finite(F.col("prediction"))
    early = -F.unix_micros(F.col("target").cast("timestamp"))
    pair = obs.isNotNull() & pred.isNotNull()
    row = F.struct(obs.alias("o"), pred.alias("p"), F.col("target").alias("t"))
    residual = F.abs(pred - obs)
    cells = forecasts.groupBy(*keys, *CELL).agg(
        F.count_if(pair).alias("sample_count"),
        F.max_by(row, F.when(pair, F.struct(obs, early))).alias("_peak"),
        F.max_by(row, F.when(pair, F.struct(residual, early))).alias("_worst"),
        F.max_by("target", F.when(obs.isNotNull(), F.struct(obs, early))).alias("_obs_at"),
        F.max_by("target", F.when(pred.isNotNull(), F.struct(pred, early))).alias("_pred_at"),
    )
    gap = F.unix_micros(F.col("_pred_at").cast("timestamp")) - F.unix_micros(
        F.col("_obs_at").cast("timestamp")
    )
    return cells.select(
        *keys,
        *CELL,
        "sample_count",
        F.col("_peak.o").alias("observed_peak"),
        F.col("_peak.t").alias("observed_peak_time"),
        F.col("_peak.p").alias("prediction_at_peak"),
        (F.col("_peak.o") - F.col("_peak.p")).alias("underestimation"),
        F.abs(F.col("_worst.p") - F.col("_worst.o")).alias("max_absolute_error"),
        F.col("_worst.t").alias("max_absolute_error_time"),
        direction(F.col("_worst.p") - F.col("_worst.o")).alias("max_absolute_error_direction"),
        F.bround(gap / F.lit(float(HOUR_US))).cast("int").alias("peak_lag_hours"),
    )


def warning_leads(
    forecasts: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str] = KEYS,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Earliest warning of every observed event of a cell.

    The targets inside an event's window are exactly the rows of its run, so the earliest
    crossing is one more aggregate of the run and needs no range join.
    """
    cell = [*keys, *CELL]
    rows = forecasts.join(thresholds.select(*keys, "threshold"), list(keys))
    crossing = above(F.col("prediction"), F.col("threshold"))
    slim = rows.select(
        *cell,
        "target",
        above(F.col("observed"), F.col("threshold")).alias("_event"),
        F.when(crossing, F.struct("anchor", "target", "prediction")).alias("_cross"),
    )
    found = runs(
        slim, cell, "target", F.col("_event"), time_block(F.col("target"), block_us),
        {"_cross": (F.min("_cross"), F.min)},
    )
    gap = F.unix_micros(F.col("run_start").cast("timestamp")) - F.unix_micros(
        F.col("_cross.anchor").cast("timestamp")
    )
    lead = gap / F.lit(float(HOUR_US))
    return found.select(
        *cell,
        F.col("run_start").alias("event_start"),
        F.col("run_end").alias("event_end"),
        F.col("run_length").alias("event_points"),
        F.when(lead > 0, F.bround(lead).cast("int")).alias("lead_hours"),
        F.col("_cross.anchor").alias("first_issue_time"),
        F.col("_cross.target").alias("first_target_time"),
        F.col("_cross.prediction").alias("first_prediction"),
        F.when(F.col("_cross").isNull(), F.lit(NO_CROSSING))
        .when(lead <= 0, F.lit(NO_ADVANCE))
        .alias("reason"),
    )


def windowed_forecasts(
    forecasts: DataFrame,
    windows: DataFrame,
    keys: Sequence[str] = KEYS,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Range join: forecasts whose target lies in an event window of the same segment.

    Each window is listed once per time block it touches; the join is then an equi join on
    (keys, segment, block) with the range as a residual condition.
    """
    start, end = F.col("event_start"), F.col("event_end")
    listed = windows.withColumn(
        BLOCK, F.explode(F.sequence(time_block(start, block_us), time_block(end, block_us)))
    )
    rows = forecasts.withColumn(BLOCK, time_block(F.col("target"), block_us))
    inside = rows.join(listed, [*keys, "segment", BLOCK]).filter(F.col("target").between(start, end))
    return inside.drop(BLOCK)


def event_errors(
    forecasts: DataFrame,
    windows: DataFrame,
    keys: Sequence[str] = KEYS,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Score and peak of every model and horizon inside each event window."""
    inside = windowed_forecasts(forecasts, windows, keys, block_us)
    obs, pred = finite(F.col("observed")), finite(F.col("prediction"))
    early = -F.unix_micros(F.col("target").cast("timestamp"))
    pair = obs.isNotNull() & pred.isNotNull()
    scored = inside.groupBy(*keys, "segment", "event_start", "model", "horizon").agg(
        *regression_aggregates()[:2],
        F.max_by(F.struct(obs.alias("o"), pred.alias("p")), F.when(pair, F.struct(obs, early))).alias("_peak"),
    )
    grid = windows.join(forecasts.select(*keys, "segment", "model", "horizon").distinct(), [*keys, "segment"])
    return grid.join(scored, [*keys, "segment", "event_start", "model", "horizon"], "left").select(
        *keys,
        "segment",
        "event_start",
        "event_end",
        "event_points",
        "model",
        "horizon",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        "mae",
        F.col("_peak.o").alias("observed_peak"),
        F.col("_peak.p").alias("peak_prediction"),
        (F.col("_peak.o") - F.col("_peak.p")).alias("peak_underestimation"),
        F.when(F.coalesce("sample_count", F.lit(0)) == 0, F.lit(NO_PAIRS)).alias("reason"),
    )


def residual_rows(
    forecasts: DataFrame, start: object, end: object, segment: str = "test"
) -> DataFrame:
    """Row diagnostics inside a closed target window: residual, size and direction."""
    residual = F.col("prediction") - F.col("observed")
    inside = (F.col("segment") == segment) & F.col("target").between(F.lit(start), F.lit(end))
    pair = finite(F.col("observed")).isNotNull() & finite(F.col("prediction")).isNotNull()
    return (
        forecasts.filter(inside & pair)
        .withColumn("absolute_error", F.abs(residual))
        .withColumn("signed_error", residual)
        .withColumn("direction", direction(residual))
    )


def phase_errors(
    forecasts: DataFrame,
    start: object,
    end: object,
    segment: str = "test",
    keys: Sequence[str] = KEYS,
    block_us: int = BLOCK_US,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Errors on rising and falling observations inside the window, per model and horizon."""
    cell = [*keys, "model", "horizon"]
    inside = forecasts.filter(
        (F.col("segment") == segment) & F.col("target").between(F.lit(start), F.lit(end))
    ).select(*cell, "target", "observed", "prediction")
    placed = equal_blocks(inside, cell, "target", block_us, block_rows)
    rows = with_previous(placed, cell, ["target"], F.col("observed"), "_before")
    step = finite(F.col("observed")) - finite(F.col("_before"))
    pair = finite(F.col("observed")).isNotNull() & finite(F.col("prediction")).isNotNull()
    signed = F.col("prediction") - F.col("observed")
    aggregates = [F.count_if(pair).alias("_pairs")]
    for phase, mask in (("rising", step > 0), ("falling", step < 0)):
        kept = F.when(mask & pair, signed)
        aggregates += [
            F.count(kept).alias(f"_{phase}_n"),
            F.avg(F.abs(kept)).alias(f"_{phase}_mae"),
            F.avg(kept).alias(f"_{phase}_mean"),
        ]
    enough = F.col("_pairs") >= 2
    lines = F.array(
        *[
            F.struct(
                F.lit(phase).alias("phase"),
                F.when(enough, F.col(f"_{phase}_n")).otherwise(F.lit(0)).alias("sample_count"),
                F.when(enough, F.col(f"_{phase}_mae")).alias("mae"),
                F.when(enough, F.col(f"_{phase}_mean")).alias("mean_signed_error"),
                F.when(~enough, F.lit(NO_PAIRS)).alias("reason"),
            )
            for phase in ("rising", "falling")
        ]
    )
    return rows.groupBy(*cell).agg(*aggregates).select(*cell, F.inline(lines))


def largest_change(
    rows: DataFrame,
    start: object,
    end: object,
    keys: Sequence[str] = KEYS,
    *,
    time: str = "target",
    level: str = "observed",
    block_us: int = BLOCK_US,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Largest change between consecutive rows in a window; the first one on ties."""
    inside = rows.filter(F.col(time).between(F.lit(start), F.lit(end))).select(*keys, time, level)
    placed = equal_blocks(inside, keys, time, block_us, block_rows)
    pairs = with_previous(placed, keys, [time], F.col(level), "_before")
    change = F.col(level) - F.col("_before")
    early = -F.unix_micros(F.col(time).cast("timestamp"))
    best = pairs.groupBy(*keys).agg(
        F.max_by(
            F.struct(change.alias("v"), F.col(time).alias("t")),
            F.when(change.isNotNull(), F.struct(F.abs(change), early)),
        ).alias("_c")
    )
    value = F.col("_c.v")
    return best.select(
        *keys,
        value.alias("value"),
        F.col("_c.t").alias("at_target"),
        F.when(value > 0, F.lit("rising")).when(value.isNotNull(), F.lit("falling")).alias("direction"),
    )

