from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import HOUR, START, observations
from tidemark.operators import forecast, quality, risk

SCHEMA = "series_key string, predictions map<int,double>, threshold double, anchor_at timestamp, last_observed_at timestamp"


def judge(spark, predictions, age_hours=1.0, **options):
    row = [("a", predictions, 7.0, START, START - age_hours * HOUR)]
    return risk.risk_levels(spark.createDataFrame(row, SCHEMA), **options).first()


@pytest.mark.parametrize(
    "predictions,level,triggered,missing",
    [
        ({1: 7.0, 3: 6.0, 6: 6.0}, "elevated", [1], []),
        ({1: 6.9, 3: 7.1, 6: 8.0}, "watch", [3, 6], []),
        ({1: 6.0, 3: 6.0, 6: 6.0}, "normal", [], []),
        ({1: 9.0, 3: 9.0, 6: 9.0}, "elevated", [1, 3, 6], []),
        ({1: None, 3: 7.5}, "watch", [3], [1, 6]),
        ({1: float("nan"), 3: float("inf"), 6: 1.0}, "normal", [], [1, 3]),
        ({1: None}, None, [], [1, 3, 6]),
    ],
)
def test_levels(spark, predictions, level, triggered, missing):
    r = judge(spark, predictions)
    assert (r.level, r.triggered_horizons, r.missing_horizons) == (level, triggered, missing)


def test_staleness_only_flags(spark):
    assert not judge(spark, {1: 9.0}, 3.0).is_stale
    late = judge(spark, {1: 9.0}, 3.001)
    assert late.is_stale and late.level == "elevated" and late.data_age_hours == pytest.approx(3.001, abs=1e-6)


def test_requests_are_checked(spark):
    rows = spark.createDataFrame(
        [("a", {1: 1.0}, 0.0, START, START), ("b", {1: None}, 7.0, START, START + HOUR)], SCHEMA
    )
    got = quality.check_rows(rows, risk.request_rules()).first()
    assert (got.bad_threshold, got.observed_after_anchor, got.no_finite_prediction) == (1, 1, 1)


ARTIFACTS = (
    "series_key string, model string, model_version string, as_of timestamp, anchor_at timestamp, priority int, "
    "points array<struct<horizon:int, target_at:timestamp, water_level_m:double>>"
)


def artifact(key, priority, as_of, horizons, value):
    return (key, "ridge", f"v{priority}", as_of, as_of, priority, [(h, as_of + h * HOUR, value + h) for h in horizons])


def test_fallback_and_candidate_order(spark):
    obs = observations(spark, {"full": {0: 1.0, 5: 2.0}, "part": {0: 3.0}, "late": {0: 4.0}})
    as_of = START + 6 * HOUR
    stored = spark.createDataFrame(
        [
            artifact("full", 2, START + 5 * HOUR, (1, 3, 6), 50.0),
            artifact("full", 1, START + HOUR, (1, 3, 6), 10.0),
            artifact("part", 1, START, (1, 3), 10.0),
            artifact("late", 1, START + 7 * HOUR, (1, 3, 6), 10.0),
        ],
        ARTIFACTS,
    )
    base = forecast.served_persistence(forecast.latest_before(obs, as_of), F.lit(as_of), (1, 3, 6), "1h")
    points = forecast.artifact_points(stored, as_of)
    got = {(r.series_key, r.horizon): r for r in forecast.choose_forecasts(base, points, "ridge", (6, 3, 1)).collect()}
    assert got[("full", 3)].water_level_m == 13.0, "the first candidate wins, not the newest"
    assert (got[("full", 1)].status, got[("full", 1)].model, got[("full", 1)].model_version) == ("ok", "ridge", "v1")
    for key, level in (("part", 3.0), ("late", 4.0)):
        r = got[(key, 1)]
        assert (r.water_level_m, r.status, r.model, r.fallback_reason) == (level, "degraded", "persistence", "model_artifact_unavailable")
    assert got[("full", 6)].target_at == as_of + 6 * HOUR
    plain = forecast.choose_forecasts(base, points, "persistence", (1, 3, 6)).first()
    assert plain.status == "ok" and plain.fallback_reason is None
    with pytest.raises(ValueError):
        forecast.checked_horizons((0, 1))


def test_worst_status_and_freshness(spark):
    df = spark.createDataFrame([("ok",), ("unavailable",), ("degraded",)], "status string")
    assert df.agg(forecast.worst_status(F.col("status")).alias("s")).first().s == "unavailable"
    latest = observations(spark, {"a": {0: 1.0}})
    for minutes, state in ((180, "fresh"), (181, "stale"), (-5, "fresh")):
        r = risk.with_freshness(latest, F.lit(START + minutes * HOUR / 60), 180).first()
        assert r.freshness == state and r.data_age_minutes == max(0, minutes)
