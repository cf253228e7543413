"""Regression scores on matching sample sets, comparisons and reconciliations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite
from tidemark.operators.blocks import KEYS
from tidemark.schemas import EVENT_METRICS_JSON

METRICS = ("mae", "rmse", "r2", "nse", "peak_absolute_error")
CELL = ("model", "horizon", "segment")

# Reasons of an empty cell.
NO_SAMPLES = "insufficient_samples"
NO_PAIRS = "no_valid_pairs"


def regression_aggregates(kept: Column | None = None) -> list[Column]:
    """Score aggregates over the pairwise-valid rows of a group, all combinable map-side."""
    valid = finite(F.col("observed")).isNotNull() & finite(F.col("prediction")).isNotNull()
    if kept is not None:
        valid = valid & kept
    obs = F.when(valid, F.col("observed"))
    pred = F.when(valid, F.col("prediction"))
    residual = pred - obs
    n = F.count(obs)
    squares = F.sum(residual * residual)
    spread = F.var_pop(obs)
    skill = F.when(spread > 0, F.lit(1.0) - squares / (n * spread))
    return [
        n.alias("sample_count"),
        F.avg(F.abs(residual)).alias("mae"),
        F.sqrt(squares / F.when(n > 0, n)).alias("rmse"),
        skill.alias("r2"),
        skill.alias("nse"),
        F.abs(F.max(obs) - F.max(pred)).alias("peak_absolute_error"),
    ]


def regression_metrics(
    forecasts: DataFrame,
    cell: Sequence[str] = CELL,
    keys: Sequence[str] = KEYS,
    cells: DataFrame | None = None,
) -> DataFrame:
    """One row per (series, model, horizon, segment); empty cells are NULL with a reason.

    Imputed targets are left out and counted when the frame marks them. ``cells`` lists the
    cells that must appear even without any row. ``peak_absolute_error`` is the difference of
    the two maxima, not an error at one time.
    """
    by = [*keys, *cell]
    marked = "is_imputed" in forecasts.columns
    kept = ~F.col("is_imputed") if marked else None
    paired = finite(F.col("observed")).isNotNull() & finite(F.col("prediction")).isNotNull()
    excluded = F.count_if(paired & F.col("is_imputed")) if marked else F.lit(0).cast("long")
    scored = forecasts.groupBy(*by).agg(
        *regression_aggregates(kept), excluded.alias("excluded_imputed"), F.count("*").alias("_rows")
    )
    if cells is not None:
        scored = cells.join(scored, by, "left")
    count = F.coalesce("sample_count", F.lit(0))
    reason = F.when(F.coalesce("_rows", F.lit(0)) == 0, F.lit(NO_SAMPLES)).when(
        count == 0, F.lit(NO_PAIRS)
    )
    return scored.select(
        *by,
        count.alias("sample_count"),
        *METRICS,
        F.coalesce("excluded_imputed", F.lit(0)).alias("excluded_imputed"),
        reason.alias("reason"),
    )


def paired_counts(
    forecasts: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = ("model", "horizon")
) -> DataFrame:
    """Paired rows over the whole table, with and without imputed targets."""
    paired = finite(F.col("observed")).isNotNull() & finite(F.col("prediction")).isNotNull()
    return forecasts.groupBy(*keys, *by).agg(
        F.count_if(paired).alias("paired_rows"),
        F.count_if(paired & ~F.col("is_imputed")).alias("paired_observed_rows"),
    )


def seed_summary(
    per_seed: DataFrame, by: Sequence[str], seed: str = "seed", metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean and population deviation over seeds; NULLs are skipped, reasons de-duplicated.

    The per-group lists are as long as the seed list.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seed).alias("s"), "sample_count", "reason")))
    out = per_seed.groupBy(*by).agg(
        ordered.alias("_runs"),
        *[F.avg(finite(F.col(m))).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_pop(finite(F.col(m))).alias(f"{m}_std") for m in metrics],
    )
    reasons = F.array_distinct(F.filter(F.col("_runs.reason"), lambda r: r.isNotNull()))
    return (
        out.withColumn("sample_count", F.col("_runs")[0]["sample_count"])
        .withColumn("sample_counts_by_seed", F.col("_runs.sample_count"))
        .withColumn("reason", F.nullif(F.array_join(reasons, "; "), F.lit("")))
        .drop("_runs")
    )


def common_support_metrics(
    forecasts: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Every model scored on the targets all of them share.

    A target becomes one row with a column for each model, which combines before the shuffle; it
    is kept when every model has a row, and scored. Two rows of one model for a target fail.
    """
    own = {m: F.col("model") == m for m in models}
    wide = forecasts.filter(F.col("model").isin(*own)).groupBy(*keys, "segment", "horizon", "target").agg(
        *[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(own.values())],
        *[F.max(F.when(c, F.col("observed"))).alias(f"_o{i}") for i, c in enumerate(own.values())],
        *[F.max(F.when(c, F.col("prediction"))).alias(f"_p{i}") for i, c in enumerate(own.values())],
    )
    least = F.least(*[F.col(f"_n{i}") for i in range(len(own))]) if len(own) > 1 else F.col("_n0")
    most = F.greatest(*[F.col(f"_n{i}") for i in range(len(own))]) if len(own) > 1 else F.col("_n0")
    single = F.when(most > 1, F.raise_error(F.lit("a model has two rows for one target")).cast("boolean")).otherwise(least > 0)
    lines = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"_o{i}").alias("observed"), F.col(f"_p{i}").alias("prediction"))
            for i, m in enumerate(own)
        ]
    )
    return regression_metrics(
        wide.filter(single).select(*keys, "segment", "horizon", "target", F.inline(lines)), CELL, keys
    )


def predictable_rows(
    forecasts: DataFrame,
    levels: DataFrame,
    models: Sequence[str],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """MAE of each model and of persistence on the anchors where every model predicts.

    ``levels`` gives ``water_level_t`` at the anchor (``observed_at``) for the persistence.
    """
    wide = forecasts.filter(F.col("model").isin(*models)).groupBy(
        *keys, "segment", "horizon", "anchor"
    ).agg(
        F.max("observed").alias("observed"),
        *[F.max(F.when(F.col("model") == m, finite(F.col("prediction")))).alias(f"_{m}") for m in models],
    )
    complete = F.col("observed").isNotNull()
    for m in models:
        complete = complete & F.col(f"_{m}").isNotNull()
    anchored = wide.filter(complete).join(
        levels.select(*keys, F.col("observed_at").alias("anchor"), "water_level_t"),
        [*keys, "anchor"],
        "left",
    )
    return anchored.groupBy(*keys, "segment", "horizon").agg(
        F.count("*").alias("sample_count"),
        F.avg(F.abs(F.col("water_level_t") - F.col("observed"))).alias("persistence_mae"),
        *[F.avg(F.abs(F.col(f"_{m}") - F.col("observed"))).alias(f"{m}_mae") for m in models],
    )


def compare_with_baseline(
    scores: DataFrame,
    baseline: DataFrame,
    on: Sequence[str] = ("series_key", "horizon", "segment"),
    metric: str = "mae",
) -> DataFrame:
    """Gap to the baseline and whether it is beaten; NULL when not computable."""
    reference = baseline.select(*on, F.col(metric).alias("baseline_value"))
    gap = F.col(metric) - F.col("baseline_value")
    return (
        scores.join(reference, list(on), "left")
        .withColumn(f"{metric}_gap", gap)
        .withColumn("beats_baseline", F.col(metric) < F.col("baseline_value"))
    )


def reconcile(
    mine: DataFrame,
    reported: DataFrame,
    on: Sequence[str],
    metrics: Sequence[str] = ("mae", "rmse", "r2", "nse"),
    tolerance: float = 1e-5,
) -> DataFrame:
    """Compare two metric tables cell by cell; ``state`` is ``ok`` or names the violation."""
    a = mine.select(
        *on, F.lit(True).alias("_a"), F.col("sample_count").alias("sample_count"),
        *[F.col(m).alias(f"_a_{m}") for m in metrics],
    )
    b = reported.select(
        *on, F.lit(True).alias("_b"), F.col("sample_count").alias("reported_count"),
        *[F.col(m).alias(f"_b_{m}") for m in metrics],
    )
    gaps = F.array_compact(F.array(*[F.abs(F.col(f"_a_{m}") - F.col(f"_b_{m}")) for m in metrics]))
    worst = F.array_max(gaps)
    state = (
        F.when(F.col("_a").isNull(), F.lit("not_computed"))
        .when(F.col("_b").isNull(), F.lit("not_reported"))
        .when(F.col("sample_count") != F.col("reported_count"), F.lit("sample_count_differs"))
        .when(F.size(gaps) == 0, F.lit("nothing_to_compare"))
        .when(worst > F.lit(tolerance), F.lit("above_tolerance"))
        .otherwise(F.lit("ok"))
    )
    return a.join(b, list(on), "full_outer").select(
        *on, "sample_count", "reported_count", worst.alias("max_abs_difference"), state.alias("state")
    )


def imputation_profile(
    forecasts: DataFrame,
    features: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    native_models: Sequence[str] = (),
) -> DataFrame:
    """Missing and imputed feature cells of the rows each model was scored on.

    Models that handle missing values themselves report zero imputed cells.
    """
    empty = F.size(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNull()))
    grid = features.select(*keys, "segment", F.col("observed_at").alias("anchor"), empty.alias("_empty"))
    native = F.col("model").isin(*native_models) if native_models else F.lit(False)
    found = F.col("_empty").isNotNull()
    return (
        forecasts.join(grid, [*keys, "segment", "anchor"], "left")
        .groupBy(*keys, *CELL)
        .agg(
            F.count("*").alias("usable_rows"),
            F.count_if(~found).alias("unmatched_rows"),
            F.count_if(F.col("_empty") > 0).alias("rows_with_missing_features"),
            F.coalesce(F.sum("_empty"), F.lit(0)).alias("missing_feature_cells"),
        )
        .withColumn("input_cells", F.col("usable_rows") * F.lit(len(columns)))
        .withColumn("missing_cell_share", F.try_divide("missing_feature_cells", "input_cells"))
        .withColumn("imputed_rows", F.when(native, 0).otherwise(F.col("rows_with_missing_features")))
        .withColumn("imputed_cells", F.when(native, 0).otherwise(F.col("missing_feature_cells")))
    )


def missing_cells(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected cells without any row (must be empty)."""
    return expected.join(actual.select(*on).distinct(), list(on), "left_anti")


def flatten_event_metrics(documents: DataFrame, column: str = "document") -> DataFrame:
    """Nested JSON segment -> h<horizon> -> model to one row per cell."""
    parsed = documents.withColumn("_m", F.from_json(F.col(column), EVENT_METRICS_JSON)).drop(column)
    keep = [c for c in parsed.columns if c != "_m"]
    by_segment = parsed.select(*keep, F.explode("_m").alias("segment", "_h"))
    by_horizon = by_segment.select(*keep, "segment", F.explode("_h").alias("_name", "_models"))
    by_model = by_horizon.select(*keep, "segment", "_name", F.explode("_models").alias("model", "_cell"))
    return by_model.select(
        *keep,
        "segment",
        F.regexp_replace("_name", "^h", "").try_cast("int").alias("horizon"),
        "model",
        "_cell.*",
    )
