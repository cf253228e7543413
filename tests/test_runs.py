from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import HOUR, START, observations, random_series
from tidemark.operators import clean, features, grid
from tidemark.plans import runs

# The 12 rows that the published counts and errors of the sample audit belong to.
SAMPLE = [
    ("2026-01-01 00:00:00", "3.10", "1001"), ("2026-01-01 01:00:00", "3.12", "1002"), ("2026-01-01 02:00:00", "3.15", "1003"),
    ("2026-01-01 03:00:00", "3.20", "1004"), ("2026-01-01 04:00:00", "3.28", "1005"), ("2026-01-01 05:00:00", "3.35", "1005"),
    ("2026-01-01 06:00:00", "", "1006"), ("2026-01-01 07:00:00", "3.52", "1007"), ("2026-01-01 25:00:00", "3.60", "1008"),
    ("2026-01-01 09:00:00", "3.66", "1009"), ("2026-01-01 10:00:00", "3.71", "1010"), ("2026-01-01 11:00:00", "3.74", "1011"),
]


#: Ten hours of our own: level 2.00 + 0.05 an hour; one blank, one text, one id used twice.
OWN = [(f"2025-05-01 {h:02}:00:00", {4: " ", 7: "n/a"}.get(h, f"{2 + 0.05 * h:.2f}"), "s8" if h == 9 else f"s{h}") for h in range(10)]


def test_own_sample_end_to_end(spark):
    df = spark.createDataFrame([("z", i, t, v, n) for n, (t, v, i) in enumerate(OWN)], "series_key string, z_id string, time_d string, up_water_level string, row_position long")
    result = runs.baseline_audit(df, F.col("row_position"))
    s = result["summary"].first()
    assert (s.total_rows, s.valid_rows, s.duplicate_rows, s.invalid_timestamp_rows, s.invalid_level_rows, s.missing_level_rows) == (10, 7, 1, 0, 1, 1)
    levels = result["grid"].orderBy("observed_at").collect()
    # Hours 4, 7 and 8 are filled along the straight line that the readings lie on.
    assert [r.observed_at.hour for r in levels if r.is_imputed] == [4, 7, 8]
    assert [round(r.water_level_m, 9) for r in levels] == [round(2 + 0.05 * h, 9) for h in range(10)]
    assert {r.segment: r.rows for r in result["segments"].collect()} == {"train": 7, "validation": 1, "test": 2}
    assert result["longest_run"].first().longest_run == 2
    # One hour ahead persistence is always 0.05 too low.
    assert {round(r.mae, 9) for r in result["metrics"].filter("horizon = 1 and sample_count > 0").collect()} == {0.05}


def raw(spark):
    rows = [("s", *r, i) for i, r in enumerate(SAMPLE)]
    return spark.createDataFrame(rows, "series_key string, time_d string, up_water_level string, z_id string, row_position int")


def test_twelve_row_sample_end_to_end(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    result = runs.baseline_audit(raw(spark), F.col("row_position"))
    s = result["summary"].first()
    assert (s.total_rows, s.valid_rows, s.duplicate_rows, s.invalid_timestamp_rows, s.invalid_level_rows, s.missing_level_rows) == (12, 9, 1, 1, 0, 1)
    assert s.inferred_interval_minutes == 60.0 and s.conserved
    levels = result["grid"]
    assert levels.count() == 12 and levels.filter("is_imputed").count() == 3
    sizes = {r.segment: r.rows for r in result["segments"].collect()}
    assert sizes == {"train": 8, "validation": 1, "test": 3}
    test = {r.horizon: r.mae for r in result["metrics"].filter("segment = 'test'").collect()}
    assert [round(test[h], 4) for h in (1, 3, 6)] == [0.05, 0.1883, 0.4283]


def test_grid_build_reports(spark):
    result = runs.grid_build(raw(spark), F.col("row_position"), max_steps=1)
    g = result["gap_statistics"].first()
    assert (g.expected_buckets, g.missing_buckets, g.gap_segments, g.longest_gap) == (12, 0, 0, 0)
    bare = runs.grid_build(raw(spark), F.col("row_position"), max_steps=0)
    g = bare["gap_statistics"].first()
    assert (g.missing_buckets, g.gap_segments, g.gap_p50) == (3, 3, 1.0)
    assert bare["top_gaps"].count() == 3 and bare["missing_days"].count() == 0
    i = bare["sampling_interval"].first()
    assert (i.mode_seconds, i.max_seconds) == (3600.0, 7200.0)
    assert {r.max_steps: r.imputed_rows for r in bare["sweep"].collect()} == {0: 0, 1: 3, 2: 3, 3: 3, 6: 3}


def test_feature_build_and_analysis(spark):
    obs = observations(spark, {"a": random_series(1, 150), "b": random_series(2, 150)})
    levels = grid.resample(obs, max_steps=2)
    points = spark.createDataFrame(
        [(START + h * HOUR, p, float(h % 5), float(h % 5) + (h == 3)) for h in range(150) for p in ("x", "y")],
        "observed_at timestamp, point_id string, rain_mm double, precipitation_mm double",
    )
    built = runs.feature_build(levels, points)
    assert built["features"].count() == levels.count()
    assert built["volume"].first().raw_diff_rows == 2 and built["mean_differences"].first().mean_diff_rows == 1
    with pytest.raises(ValueError, match="repeated"):
        runs.feature_build(levels, points.unionByName(points.limit(1)))
    base = runs.hourly_baseline(levels)
    counts = base["metrics"].groupBy("series_key", "horizon", "segment").agg(F.count_distinct("sample_count").alias("n"))
    assert {r.n for r in counts.collect()} == {1}, "the constant is scored on the same rows"
    model = base["forecasts"].filter("model = 'train_mean' and not is_imputed and prediction is not null and observed is not null")
    result = runs.error_analysis(
        levels, built["features"], model, ["train_mean"], (START + 100 * HOUR, START + 149 * HOUR), reported=base["metrics"]
    )
    assert {r.state for r in result["cross_check"].collect()} == {"ok"}
    for name, frame in result.items():
        assert frame.count() > 0 or name in ("leads", "event_errors"), name


def test_serving_bundle(spark):
    obs = observations(spark, {"a": {h: float(h) for h in range(20)}, "b": {0: 1.0}})
    none = spark.createDataFrame(
        [], "series_key string, model string, model_version string, as_of timestamp, anchor_at timestamp, priority int, "
        "points array<struct<horizon:int, target_at:timestamp, water_level_m:double>>"
    )
    limits = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "series_key string, threshold double")
    as_of = START + dt.timedelta(hours=12, minutes=30)
    got = {r.series_key: r for r in runs.serving_bundle(obs, none, limits, as_of, model="ridge").collect()}
    assert (got["a"].level, got["a"].status, got["a"].freshness, got["a"].predictions) == ("elevated", "degraded", "fresh", {1: 12.0, 3: 12.0, 6: 12.0})
    assert (got["b"].level, got["b"].freshness, got["b"].is_stale) == ("normal", "stale", True)
    assert got["a"].generated_at == as_of


def test_experiment_grid(spark):
    from tidemark.operators import models

    obs = observations(spark, {"a": random_series(3, 240, keep=0.98, decimals=3)})
    rain = spark.createDataFrame([(START + h * HOUR, float(h % 5), 1) for h in range(240)], "observed_at timestamp, rainfall_mm double, point_count long")
    m = features.features_from_observations(obs, rain, max_steps=2).cache()
    predictions = models.run_experiments(m, horizons=(1, 3), seeds=(1, 2), rounds=3)
    scores = models.experiment_scores(predictions).collect()
    assert len(scores) == 2 * 2 * 2 * 3
    ridge = [r for r in scores if r.model == "ridge"]
    assert all(r.mae_std in (0.0, None) for r in ridge)
    assert {len(r.sample_counts_by_seed) for r in scores} == {2}
    m.unpersist()


def test_sorted_output(spark):
    obs = clean.normalise(raw(spark), F.col("row_position"))
    assert [r.source_record_id for r in clean.sorted_observations(obs).collect()][:2] == ["1001", "1002"]


def test_hourly_baseline_reads_its_levels_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(runs, "stored", lambda df, name: names.append(name) or df.localCheckpoint())
    rows = [("s", f"2025-05-{d:02} {h:02}:00:00", d + h * 0.1, f"{d}-{h}") for d in (1, 2) for h in range(24)]
    obs = spark.createDataFrame(rows, "series_key string, t string, water_level_m double, source_record_id string")
    result = runs.hourly_baseline(grid.resample(obs.withColumn("observed_at", F.to_timestamp("t")), "1h", max_steps=2))
    assert names == ["lagged"]
    assert not any("Window" in df._jdf.queryExecution().optimizedPlan().toString() for df in result.values())
    assert result["forecasts"].count() == 2 * 3 * 48
    assert {r.horizon: r.paired_rows for r in result["paired"].collect()} == {h: 48 - h for h in (1, 3, 6)}
