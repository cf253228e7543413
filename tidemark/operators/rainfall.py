"""Areal means of gridded covariates and their alignment evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import differs, finite
from tidemark.functions.timeline import HOUR_US, step_index, step_start
from tidemark.operators.blocks import DEFAULT_BLOCK_STEPS, spread_steps
from tidemark.operators.quality import no_rows_expected


def repeated_points(points: DataFrame) -> DataFrame:
    """(time, point) pairs that occur more than once; averaging would count them twice."""
    return points.groupBy("observed_at", "point_id").agg(F.count("*").alias("n")).filter("n > 1")


def unknown_points(wanted: DataFrame, points: DataFrame) -> DataFrame:
    """Requested points the data does not hold."""
    return wanted.select("point_id").join(points.select("point_id").distinct(), "point_id", "left_anti")


def select_points(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keep the requested points; an unknown one is an error."""
    no_rows_expected(unknown_points(wanted, points), "unknown points requested")
    return points.join(wanted.select("point_id").distinct(), "point_id", "left_semi")


def areal_mean(
    points: DataFrame,
    value: str = "rain_mm",
    *,
    keys: Sequence[str] = (),
    complete: bool = True,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Equal-weight mean over points per hour, with the number of points that took part.

    Hours without any row are present with a NULL mean and count 0. They are unioned into
    the aggregation, like the empty steps of a grid.
    """
    hour = step_index(F.col("observed_at"), HOUR_US)
    rows = points.select(
        *keys, hour.alias("_hour"), F.col("observed_at").alias("_at"), finite(F.col(value)).alias("_v")
    )
    if complete:
        bounds = points.groupBy(*keys).agg(F.min(hour).alias("_a"), F.max(hour).alias("_b"))
        empty = spread_steps(bounds.filter("_a is not null"), keys, "_a", "_b", "_hour", block_steps)
        rows = rows.unionByName(
            empty.select(
                *keys,
                "_hour",
                step_start(F.col("_hour"), HOUR_US).alias("_at"),
                F.lit(None).cast("double").alias("_v"),
            )
        )
    return rows.groupBy(*keys, F.col("_at").cast("timestamp").alias("observed_at")).agg(
        F.avg("_v").alias("rainfall_mm"), F.count("_v").alias("point_count")
    )


def source_volume(points: DataFrame, file: Column | None = None) -> DataFrame:
    """Files, rows, span, points and rows where the two measures disagree."""
    shown = file if file is not None else F.lit(None).cast("string")
    per_pair = points.groupBy(shown.alias("_file"), "point_id").agg(
        F.count("*").alias("_n"),
        F.min("observed_at").alias("_a"),
        F.max("observed_at").alias("_b"),
        F.count_if(differs(F.col("precipitation_mm"), F.col("rain_mm"))).alias("_d"),
    )
    return per_pair.agg(
        F.count_distinct("_file").alias("files"),
        F.count_distinct("point_id").alias("points"),
        F.sum("_n").alias("rows"),
        F.min("_a").alias("first_at"),
        F.max("_b").alias("last_at"),
        F.sum("_d").alias("raw_diff_rows"),
    )


def mean_differences(points: DataFrame) -> DataFrame:
    """Hours where the areal means of the two measures disagree, counted in one pass."""
    hourly = points.groupBy("observed_at").agg(
        F.avg(finite(F.col("precipitation_mm"))).alias("_p"), F.avg(finite(F.col("rain_mm"))).alias("_r")
    )
    return hourly.agg(
        F.count("*").alias("hours"), F.count_if(differs(F.col("_p"), F.col("_r"))).alias("mean_diff_rows")
    )


def measure_gaps(points: DataFrame, keys: Sequence[str] = ("point_id",)) -> DataFrame:
    """First differing time and largest absolute difference of the two measures."""
    a, b = finite(F.col("precipitation_mm")), finite(F.col("rain_mm"))
    return points.groupBy(*keys).agg(
        F.count_if(~a.eqNullSafe(b)).alias("diff_rows"),
        F.min(F.when(~a.eqNullSafe(b), F.col("observed_at"))).alias("first_diff_at"),
        F.max(F.abs(a - b)).alias("max_abs_diff"),
    )


def alignment_evidence(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distribution of the joined point count; the NULL row counts the unmatched hours."""
    return features.groupBy(*keys, "rain_point_count").agg(F.count("*").alias("hours"))
