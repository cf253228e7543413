"""Composite runs. Each returns named result DataFrames; tables read more than once are stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clean, events, forecast, grid, metrics, quality, rainfall, risk
from tidemark.operators import features as feature_ops
from tidemark.operators.blocks import KEYS
from tidemark.plans.stage import stored


def baseline_audit(
    raw: DataFrame,
    position: Column,
    *,
    step: str = "1h",
    max_steps: int = 2,
    horizons: Sequence[int] = (1, 3, 6),
    train: float = 0.70,
    validation: float = 0.15,
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Raw text to audit counters, grid, segments, persistence forecasts and their scores."""
    audit = stored(clean.audit_ids(raw, position, keys), "audit")
    obs = clean.audited_observations(audit, keys)
    levels = stored(grid.resample(obs, step, max_steps=max_steps, keys=keys), "grid")
    split = grid.require_splittable(grid.chronological_split(levels, train, validation), keys)
    forecasts = forecast.persistence_forecasts(split, horizons, step, keys)
    return {
        "summary": quality.quality_summary(clean.audited_counts(audit, keys), obs, keys),
        "observations": obs,
        "grid": levels,
        "forecasts": forecasts,
        "metrics": metrics.regression_metrics(forecasts.drop("is_imputed"), keys=keys),
        "segments": quality.segment_counters(split, keys),
        "longest_run": quality.longest_run(levels, keys),
    }


def grid_build(
    raw: DataFrame,
    position: Column,
    *,
    step: str = "1h",
    max_steps: int,
    candidates: Sequence[int] = (0, 1, 2, 3, 6),
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Hourly grid with its quality evidence.

    The unfilled grid is stored once; the delivered fill, the threshold sweep and the gap
    reports all read it.
    """
    audit = stored(clean.audit_ids(raw, position, keys), "audit")
    obs = clean.audited_observations(audit, keys)
    base = stored(grid.complete_grid(obs, step, keys), "unfilled")
    levels = stored(grid.fill_short_gaps(base, max_steps, keys), "grid")
    gaps = quality.missing_runs(levels, keys)
    split = grid.chronological_split(levels)
    return {
        "summary": clean.audited_counts(audit, keys),
        "grid": levels,
        "sweep": grid.interpolation_sweep(base, candidates, horizons, keys),
        "gap_statistics": quality.gap_statistics(levels, keys),
        "top_gaps": quality.top_gaps(gaps, 10, keys),
        "sampling_interval": quality.sampling_interval(obs, keys),
        "day_coverage": quality.day_coverage(obs, keys),
        "missing_days": quality.missing_days(obs, keys),
        "usable_samples": quality.usable_samples(levels, horizons, keys),
        "segments": quality.segment_coverage(split, horizons, keys),
    }


def hourly_baseline(
    levels: DataFrame,
    *,
    step: str = "1h",
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Persistence and the train-mean constant scored on identical sample sets.

    The levels are read once; what is stored is each grid row with its lags, which all tables are made of.
    """
    lagged = stored(forecast.lagged_levels(grid.chronological_split(levels), horizons, keys), "lagged")
    persistence = forecast.persistence_lines(lagged, horizons, step, keys)
    means = forecast.train_means(lagged, keys)
    constant = forecast.constant_forecasts(persistence, means, keys)
    both = persistence.unionByName(constant)
    return {
        "train_means": means,
        "forecasts": both,
        "metrics": metrics.regression_metrics(both, keys=keys),
        "paired": metrics.paired_counts(both, keys),
    }


def feature_build(
    levels: DataFrame,
    points: DataFrame,
    *,
    value: str = "rain_mm",
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Areal rainfall, the feature matrix and its evidence tables."""
    quality.no_rows_expected(rainfall.repeated_points(points), "repeated (time, point) rows")
    rain = stored(rainfall.areal_mean(points, value), "rain")
    matrix = stored(
        feature_ops.feature_matrix(levels, rain, horizons=horizons, keys=keys), "features"
    )
    return {
        "rain": rain,
        "features": matrix,
        "ladder": feature_ops.usability_ladder(levels, horizons=horizons, keys=keys),
        "imputed_rows": feature_ops.imputed_rows(levels, keys),
        "usable": feature_ops.usable_per_segment(matrix, horizons, keys),
        "alignment": rainfall.alignment_evidence(matrix, keys),
        "volume": rainfall.source_volume(points),
        "mean_differences": rainfall.mean_differences(points),
    }


def error_analysis(
    levels: DataFrame,
    features: DataFrame,
    model_forecasts: DataFrame,
    models: Sequence[str],
    focus: tuple[object, object],
    *,
    columns: Sequence[str] = feature_ops.FEATURE_SETS["E2"],
    reported: DataFrame | None = None,
    step: str = "1h",
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """All models next to persistence: scores, events, peaks, leads, phases, common support."""
    split = grid.chronological_split(levels)
    persistence = forecast.scored_rows(forecast.persistence_forecasts(split, horizons, step, keys))
    shared = [*keys, "model", "horizon", "segment", "anchor", "target", "observed", "prediction"]
    everything = stored(
        persistence.select(*shared).unionByName(model_forecasts.select(*shared)), "forecasts"
    )
    names = [forecast.PERSISTENCE, *models]
    threshold = stored(events.fit_thresholds(features, 0.90, keys), "threshold")
    sensitivity = stored(events.fit_thresholds(features, 0.80, keys), "threshold")
    windows = stored(events.event_windows(features, threshold, keys), "windows")
    scores = metrics.regression_metrics(everything, keys=keys)
    cell = [*keys, "model", "horizon", "segment"]
    result = {
        "threshold": threshold,
        "threshold_sensitivity": sensitivity,
        "metrics": scores,
        "event_summary": events.event_summary(features, threshold, keys),
        "event_summary_sensitivity": events.event_summary(features, sensitivity, keys),
        "event_metrics": events.event_metrics(everything, threshold, keys),
        "event_metrics_sensitivity": events.event_metrics(everything, sensitivity, keys),
        "event_errors": events.event_errors(everything, windows, keys),
        "peaks": events.peak_diagnostics(everything, keys),
        "leads": events.warning_leads(everything, threshold, keys),
        "focus_rows": events.residual_rows(everything, *focus),
        "phases": events.phase_errors(everything, *focus, keys=keys),
        "largest_change": events.largest_change(
            everything.filter(
                (F.col("model") == forecast.PERSISTENCE)
                & (F.col("horizon") == min(horizons))
                & (F.col("segment") == "test")
            ),
            *focus,
            keys=keys,
        ),
        "common_support": metrics.common_support_metrics(everything, names, keys),
        "imputation": metrics.imputation_profile(model_forecasts, features, columns, keys),
        "usable": feature_ops.usable_per_segment(features, horizons, keys),
    }
    if reported is not None:
        result["cross_check"] = metrics.reconcile(scores, reported, cell)
    return result


def serving_bundle(
    obs: DataFrame,
    artifacts: DataFrame,
    thresholds: DataFrame,
    as_of: object,
    *,
    model: str,
    horizons: Sequence[int] = (1, 3, 6),
    step: str = "1h",
    stale_after_minutes: float = 180.0,
    comparison: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Score every station at one moment: latest level, forecast or fallback, risk.

    Persistence issues the anchor's own level for ``as_of + h``, consistent with the
    forecasts that are scored elsewhere.
    """
    latest = stored(forecast.latest_before(obs, as_of, keys), "latest")
    moment = F.lit(as_of)
    persistence = forecast.served_persistence(latest, moment, horizons, step, keys)
    points = forecast.artifact_points(artifacts, as_of, keys)
    served = forecast.choose_forecasts(persistence, points, model, horizons, keys)
    return risk.station_bundle(
        latest, served, thresholds, comparison, as_of=moment, horizons=horizons,
        stale_after_minutes=stale_after_minutes, keys=keys,
    )
