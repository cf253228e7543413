"""Table schemas and the row rules that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import optional_text

# The table contracts, as DDL text accepted by ``spark.read.schema``.
RAW = (
    "z_id string, time_d string, up_water_level string, station_code string, station_name string"
)
OBSERVATIONS = (
    "series_key string, source_record_id string, observed_at timestamp, water_level_m double, "
    "station_code string, station_name string, quality_flag string"
)
GRID = (
    "series_key string, observed_at timestamp, water_level_m double, is_imputed boolean, "
    "quality_flag string, source_record_id string, station_code string, station_name string"
)
RAIN_POINTS = (
    "observed_at string, precipitation_mm double, rain_mm double, point_id string, "
    "longitude double, latitude double"
)
RAIN = ("observed_at timestamp, rainfall_mm double, point_count bigint")
FORECASTS = (
    "series_key string, model string, horizon int, segment string, anchor timestamp, "
    "target timestamp, observed double, prediction double"
)
PREDICTION_FILE = (
    "observed_at string, segment string, observed double, prediction double"
)
ARCHIVE_RESPONSE = (
    "latitude double, longitude double, elevation double, utc_offset_seconds int, "
    "hourly struct<time:array<string>, precipitation:array<double>, rain:array<double>>"
)
PREDICTION_ARTIFACT = (
    "model string, model_version string, as_of string, anchor_at string, "
    "points array<struct<horizon:int, target_at:string, water_level_m:double>>"
)
EVENT_METRICS_JSON = (
    "map<string, map<string, map<string, struct<precision:double, recall:double, f1:double, "
    "tp:bigint, fp:bigint, fn:bigint, observed_event_points:bigint, "
    "observed_event_segments:bigint, predicted_event_points:bigint, "
    "predicted_event_segments:bigint, reason:string>>>>"
)
QUALITY_FLAGS = ("normal", "suspected", "invalid", "imputed")


def observation_rules() -> dict[str, Column]:
    """A rule is true for a row that breaks the contract."""
    level = F.col("water_level_m")
    return {
        "blank_id": optional_text(F.col("source_record_id")).isNull(),
        "missing_time": F.col("observed_at").isNull(),
        "non_finite_level": level.isNull() | F.isnan(level) | (F.abs(level) == float("inf")),
        "unknown_flag": ~F.coalesce(F.col("quality_flag"), F.lit("")).isin(*QUALITY_FLAGS),
    }


def summary_rules() -> dict[str, Column]:
    parts = (
        F.col("valid_rows") + F.col("duplicate_rows") + F.col("invalid_timestamp_rows")
        + F.col("invalid_level_rows") + F.col("missing_level_rows")
    )
    return {
        "counts_not_conserved": F.col("total_rows") != parts,
        "inverted_span": F.coalesce(F.col("start_at") > F.col("end_at"), F.lit(False)),
        "valid_without_span": (F.col("valid_rows") > 0) & F.col("start_at").isNull(),
    }


def point_rules() -> dict[str, Column]:
    """Grid-point attributes: non-empty id and finite coordinates on the globe."""
    return {
        "blank_point": optional_text(F.col("point_id")).isNull(),
        "bad_longitude": ~F.coalesce(F.abs("longitude") <= 180.0, F.lit(False)),
        "bad_latitude": ~F.coalesce(F.abs("latitude") <= 90.0, F.lit(False)),
    }


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    """The frame must hold every one of the columns."""
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"{what} lack column(s) {', '.join(absent)}")
