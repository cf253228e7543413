"""The double columns of each query, so that the checking SQL can round them like Spark."""

from __future__ import annotations

# Query name to its double columns.
DOUBLES = {
    "hourly_last_value": "water_level_m",
    "hourly_grid_gapfill": "water_level_m",
    "station_grid_gapfill": "water_level_m",
    "daily_grid": "water_level_m",
    "interpolation_sweep": "imputed_rate",
    "chronological_segments": "missing_rate",
    "segment_counters": "imputed_ratio",
    "normalised_observations": "water_level_m",
    "quality_audit": "inferred_interval_minutes",
    "sample_rows": "water_level_m",
    "scalar_coercion": "ratio",
    "history_range": "water_level_m",
    "latest_points": "water_level_m",
    "gap_statistics": "missing_rate gap_p50 gap_p90 gap_p99",
    "sampling_interval": "mode_seconds median_seconds min_seconds max_seconds interval_minutes",
    "chunk_quality": "max_abs_diff missing_rate",
    "areal_mean": "rainfall_mm",
    "measure_gaps": "max_abs_diff",
    "feature_matrix": "water_level_t water_level_lag_1 water_level_lag_2 water_level_lag_3 water_level_lag_6 water_level_lag_12 water_level_lag_24 rain_lag_0 rain_lag_1 rain_lag_2 rain_lag_3 rain_lag_6 rain_lag_12 rain_cum_1 rain_cum_3 rain_cum_6 rain_cum_12 rain_cum_24 target_h1 target_h3 target_h6",
    "station_feature_matrix": "water_level_t water_level_lag_1 water_level_lag_2 water_level_lag_3 water_level_lag_6 water_level_lag_12 water_level_lag_24 rain_lag_0 rain_lag_1 rain_lag_2 rain_lag_3 rain_lag_6 rain_lag_12 rain_cum_1 rain_cum_3 rain_cum_6 rain_cum_12 rain_cum_24 target_h1 target_h3 target_h6",
    "experiment_features": "water_level_t water_level_lag_1 water_level_lag_2 water_level_lag_3 water_level_lag_6 water_level_lag_12 water_level_lag_24",
    "imputed_rows": "water_level_m",
    "persistence_forecast": "observed prediction",
    "persistence_metrics": "mae rmse r2 nse peak_absolute_error",
    "train_mean_metrics": "mae rmse r2 nse peak_absolute_error",
    "common_support_metrics": "mae rmse nse",
    "predictable_rows": "persistence_mae anchor_mae",
    "baseline_comparison": "mae baseline_value mae_gap",
    "seed_summary": "mae_mean mae_std nse_mean nse_std",
    "metric_reconcile": "max_abs_difference",
    "imputation_profile": "missing_cell_share",
    "high_level_thresholds": "threshold",
    "threshold_sensitivity": "threshold",
    "event_summary": "threshold max_level",
    "event_metrics": "precision recall f1",
    "nested_metrics_flatten": "precision recall f1",
    "peak_diagnostics": "observed_peak prediction_at_peak underestimation max_absolute_error",
    "warning_lead": "first_prediction",
    "event_errors": "mae observed_peak peak_prediction peak_underestimation",
    "residual_rows": "absolute_error signed_error",
    "phase_error": "mae mean_signed_error",
    "max_change": "value",
    "asof_latest": "water_level_m",
    "freshness": "water_level_m data_age_minutes",
    "forecast_fallback": "water_level_m",
    "station_bundle": "water_level_m data_age_minutes p1 p3 p6 threshold data_age_hours",
    "risk_levels": "threshold",
    "feature_statistics": "mean scale",
    "train_medians": "median",
    "filled_samples": "rows total",
    "moment_matrices": "moment",
    "contract_csv_round_trip": "water_level_m",
    "grid_table_round_trip": "water_level_m",
    "rain_files_round_trip": "precipitation_mm rain_mm",
    "results_round_trip": "ratio",
    "one_series": "water_level_m",
    "serving_run": "p1 p3 p6",
    "prediction_files_round_trip": "observed prediction",
    "feature_file_round_trip": "water_level_t water_level_lag_24 rain_lag_0 rain_cum_24 target_h1",
    "ridge_fit": "alpha intercept weight",
    "ridge_select": "alpha validation_mae",
    "ridge_metrics": "mae rmse r2 nse peak_absolute_error",
    "archive_rows": "precipitation_mm rain_mm",
    "json_safe_rows": "ratio nested",
}
