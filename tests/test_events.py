from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import HOUR, START, observations, random_series
from tidemark.functions.timeline import HOUR_US
from tidemark.operators import blocks, events, forecast, grid, metrics, quality, quantiles
from tidemark.operators.quantiles import exact_quantiles


def brute_runs(points):
    """Runs of true flags over (time, flag) pairs in time order."""
    found, current = [], []
    for when, flag in sorted(points):
        if flag:
            current.append(when)
        elif current:
            found.append((current[0], current[-1], len(current)))
            current = []
    if current:
        found.append((current[0], current[-1], len(current)))
    return found


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force_for_any_block_width(spark, width, seed):
    rng = np.random.default_rng(seed)
    data = {
        k: [(int(t), bool(rng.random() < p)) for t in sorted(rng.choice(200, 90, replace=False))]
        for k, p in (("dense", 0.9), ("half", 0.5), ("rare", 0.05), ("all", 1.1), ("none", -1.0))
    }
    df = spark.createDataFrame([(k, t, f) for k, v in data.items() for t, f in v], "k string, t long, f boolean")
    extra = {"total": (F.sum("t"), F.sum)}
    got = blocks.runs(df, ["k"], "t", F.col("f"), blocks.position_block(F.col("t"), width), extra).collect()
    for key, points in data.items():
        mine = sorted((r.run_start, r.run_end, r.run_length) for r in got if r.k == key)
        assert mine == brute_runs(points), (key, width)
    assert sum(r.total for r in got) == sum(t for v in data.values() for t, f in v if f)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_previous_row_crosses_blocks(spark, width):
    rng = np.random.default_rng(5)
    data = {k: sorted(int(t) for t in rng.choice(300, 60, replace=False)) for k in "ab"}
    df = spark.createDataFrame([(k, t, t * 10) for k, v in data.items() for t in v], "k string, t long, v long")
    got = blocks.with_previous(df, ["k"], ["t"], F.col("v"), "p", blocks.position_block(F.col("t"), width))
    before = {(k, t): (v[i - 1] * 10 if i else None) for k, v in data.items() for i, t in enumerate(v)}
    rows = got.collect()
    assert len(rows) == 120 and all(r.p == before[(r.k, r.t)] for r in rows)


@pytest.mark.parametrize("bins,most", [(2, 1), (3, 4), (64, 20), (64, 4096)])
def test_quantiles_are_exact(spark, bins, most):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=101), "b": np.round(rng.normal(size=57), 1), "c": np.array([4.0]), "d": np.array([1.0, 1.0, 1e9])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double")
    qs = [0.0, 0.1, 0.5, 0.8, 0.9, 1.0]
    got = {(r.k, r["quantile"]): r.value for r in exact_quantiles(df, "x", qs, ["k"], bins, most).collect()}
    for k, v in data.items():
        for q in qs:
            assert got[(k, q)] == pytest.approx(float(np.quantile(v, q)), abs=1e-9)


@pytest.mark.parametrize("few", [20_000, 10])
def test_thresholds_are_hashed_and_never_the_rows_they_meet(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    df = spark.range(6000).select((F.col("id") % 300).cast("string").alias("k"), (F.col("id") % 7919).cast("double").alias("x"))
    found = exact_quantiles(df, "x", [0.5], ["k"])
    # Rows that are still to be expanded look fewer than the thresholds.
    grown = df.select("k").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(50))))
    joined = grown.join(found, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert ("BroadcastExchange" in plan) == (few > 300) and ("ShuffledHashJoin" in plan) == (few < 300)
    want = {str(k): float(np.median([i % 7919 for i in range(k, 6000, 300)])) for k in range(300)}
    got = joined.groupBy("k").agg(F.min("value").alias("value"), F.count("*").alias("n")).collect()
    assert {r.k: r.value for r in got} == want and {r.n for r in got} == {50}


def number(v):
    return None if v is None else float(v)


def forecasts(spark, rows):
    return spark.createDataFrame(
        [("a", "m", 1, "test", START + (t - 1) * HOUR, START + t * HOUR, number(o), number(p)) for t, o, p in rows],
        "series_key string, model string, horizon int, segment string, anchor timestamp, target timestamp, observed double, prediction double",
    )


def limit(spark, value):
    return spark.createDataFrame([("a", value)], "series_key string, threshold double")


def test_regression_hand_values(spark):
    df = forecasts(spark, list(zip(range(5), [1.0, 2, 3, 4, 5], [1.5, 2.5, 2.5, 4.5, 4.0])))
    r = metrics.regression_metrics(df).first()
    assert r.sample_count == 5
    assert (round(r.mae, 6), round(r.rmse, 6), round(r.r2, 6), round(r.nse, 6), r.peak_absolute_error) == (0.6, 0.632456, 0.8, 0.8, 0.5)
    flat = metrics.regression_metrics(forecasts(spark, [(0, 2.0, 1.0), (1, 2.0, 3.0)])).first()
    assert flat.r2 is None and flat.mae == 1.0
    pairs = metrics.regression_metrics(forecasts(spark, [(0, 1.0, 2.0), (1, None, 2.0), (2, 3.0, float("nan")), (3, 2.0, 3.0)])).first()
    assert (pairs.sample_count, pairs.nse) == (2, -3.0)
    empty = metrics.regression_metrics(forecasts(spark, [(0, None, 1.0)])).first()
    assert (empty.sample_count, empty.mae, empty.reason) == (0, None, "no_valid_pairs")


def test_expected_cells_appear_without_rows(spark):
    cells = quality.expected_grid(spark, series_key=["a"], model=["m"], horizon=[1, 3], segment=["test"])
    got = {r.horizon: r for r in metrics.regression_metrics(forecasts(spark, [(0, 1.0, 1.0)]), cells=cells).collect()}
    assert got[1].sample_count == 1 and got[3].reason == "insufficient_samples"


@pytest.mark.parametrize("block_us", [HOUR_US, 5 * HOUR_US, 4096 * HOUR_US])
def test_event_metrics_and_reasons(spark, block_us):
    o = [5, 5, 1, 5, 1, 1, 5, 5]
    p = [5, 1, 1, 5, 5, 1, 5, 5]
    df = forecasts(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(o, p))])
    r = events.event_metrics(df, limit(spark, 5.0), block_us=block_us).first()
    assert (r.tp, r.fp, r.fn) == (4, 1, 1)
    assert (r.observed_event_segments, r.predicted_event_segments) == (3, 3)
    assert r.precision == 0.8 and r.recall == 0.8 and r.f1 == pytest.approx(0.8)
    none = events.event_metrics(df, limit(spark, 9.0), block_us=block_us).first()
    assert none.reason == "no_observed_events" and none.f1 is None
    low = forecasts(spark, [(0, 5.0, 1.0)])
    missed = events.event_metrics(low, limit(spark, 5.0), block_us=block_us).first()
    assert missed.reason == "no_predicted_events" and missed.fn == 1 and missed.precision is None


@pytest.mark.parametrize("block_us", [HOUR_US, 4096 * HOUR_US])
def test_leads(spark, block_us):
    base = forecasts(spark, [(10, 1.0, 1.0), (11, 7.0, 1.0), (12, 8.0, 9.0), (13, 1.0, 1.0), (20, 9.0, 2.0), (21, 0.0, 0.0), (22, 9.0, 9.0)])
    early = base.withColumn("anchor", F.col("target") - F.expr("interval 3 hours"))
    got = events.warning_leads(early, limit(spark, 7.0), block_us=block_us).orderBy("event_start").collect()
    assert [(r.event_points, r.lead_hours, r.reason) for r in got] == [
        (2, 2, None), (1, None, "no_prediction_above_threshold"), (1, 3, None)
    ]
    late = base.withColumn("anchor", F.col("target"))
    assert events.warning_leads(late, limit(spark, 7.0), block_us=block_us).orderBy("event_start").first().reason == "crossing_after_event_start"


def test_peaks_take_the_first_on_ties(spark):
    r = events.peak_diagnostics(forecasts(spark, [(0, 1.0, 4.0), (1, 5.0, 3.0), (2, 5.0, 5.0), (3, None, 9.0)])).first()
    assert (r.observed_peak, r.observed_peak_time, r.prediction_at_peak, r.underestimation) == (5.0, START + HOUR, 3.0, 2.0)
    assert (r.max_absolute_error, r.max_absolute_error_direction, r.max_absolute_error_time) == (3.0, "over", START)
    assert r.peak_lag_hours == 2 and r.sample_count == 3


@pytest.mark.parametrize("block_us", [HOUR_US, 4096 * HOUR_US])
def test_event_windows_bridge_missing_hours_and_errors_join_them(spark, block_us):
    levels = {h: (9.0 if 20 <= h <= 24 or 40 <= h <= 43 else 1.0) for h in range(60) if h not in (22, 41, 42)}
    split = grid.chronological_split(grid.resample(observations(spark, {"a": levels}), max_steps=0))
    features = split.withColumnsRenamed({"water_level_m": "water_level_t", "is_imputed": "is_imputed_t"})
    found = events.event_windows(features, limit(spark, 9.0), block_us=block_us).orderBy("event_start").collect()
    spans = [((r.event_start - START) // HOUR, (r.event_end - START) // HOUR, r.event_points) for r in found]
    assert spans == [(20, 24, 4), (40, 40, 1), (43, 43, 1)] or spans == [(20, 24, 4), (40, 43, 2)]
    fc = forecast.scored_rows(forecast.persistence_forecasts(split))
    windows = events.event_windows(features, limit(spark, 9.0), block_us=block_us)
    got = events.event_errors(fc, windows, block_us=block_us)
    inside = {
        (r.event_start, r.horizon): (r.sample_count, r.mae) for r in got.collect()
    }
    for w in found:
        for h in (1, 3, 6):
            rows = [r for r in fc.collect() if r.horizon == h and r.segment == w.segment and w.event_start <= r.target <= w.event_end]
            count, mae = inside[(w.event_start, h)]
            assert count == len(rows)
            assert (mae is None) == (not rows)
            if rows:
                assert mae == pytest.approx(np.mean([abs(r.prediction - r.observed) for r in rows]))


@pytest.mark.parametrize("block_us", [HOUR_US, 4096 * HOUR_US])
def test_phases_and_largest_change(spark, block_us):
    df = forecasts(spark, [(0, 1.0, 1.0), (2, 3.0, 2.0), (3, 1.0, 2.0), (5, 1.0, 0.0), (9, 2.0, 2.5)])
    got = {r.phase: r for r in events.phase_errors(df, START, START + 20 * HOUR, block_us=block_us).collect()}
    assert (got["rising"].sample_count, got["rising"].mae, got["rising"].mean_signed_error) == (2, 0.75, -0.25)
    assert (got["falling"].sample_count, got["falling"].mae) == (1, 1.0)
    few = events.phase_errors(df, START, START + HOUR, block_us=block_us).collect()
    assert {r.reason for r in few} == {"no_valid_pairs"}
    change = events.largest_change(df, START, START + 20 * HOUR, block_us=block_us).first()
    assert (change.value, change.at_target, change.direction) == (2.0, START + 2 * HOUR, "rising")


def test_train_threshold_ignores_other_segments(spark):
    series = {"a": {h: float(h if h < 70 else 1000 + h) for h in range(100)}}
    split = grid.chronological_split(grid.resample(observations(spark, series), max_steps=0))
    features = split.withColumnsRenamed({"water_level_m": "water_level_t", "is_imputed": "is_imputed_t"})
    r = events.fit_thresholds(features, 0.9).first()
    assert r.threshold == pytest.approx(np.quantile(np.arange(70.0), 0.9)) and r.fit_rows == 70
    with pytest.raises(ValueError):
        events.fit_thresholds(features, 0.0)


def test_common_support_and_reconcile(spark):
    a = forecasts(spark, [(0, 1.0, 2.0), (1, 2.0, 2.0), (2, 3.0, 5.0)])
    b = forecasts(spark, [(1, 2.0, 4.0), (2, 3.0, 3.0)]).withColumn("model", F.lit("n"))
    got = {r.model: r for r in metrics.common_support_metrics(a.unionByName(b), ["m", "n"]).collect()}
    assert (got["m"].sample_count, got["m"].mae, got["n"].mae) == (2, 1.0, 1.0)
    cell = ["series_key", "model", "horizon", "segment"]
    mine = metrics.regression_metrics(a.unionByName(b))
    assert {r.state for r in metrics.reconcile(mine, mine, cell).collect()} == {"ok"}
    shifted = mine.withColumn("mae", F.col("mae") + 1e-3)
    assert {r.state for r in metrics.reconcile(mine, shifted, cell).collect()} == {"above_tolerance"}
    part = mine.filter("model = 'm'")
    assert {r.state for r in metrics.reconcile(part, mine, cell).collect()} == {"ok", "not_computed"}


def test_asof_join_crosses_blocks(spark):
    obs = observations(spark, {"a": random_series(1, keep=0.2), "b": {5: 1.0}})
    asked = spark.createDataFrame(
        [(k, START + h * HOUR) for k in ("a", "b", "c") for h in (-1, 0, 4, 5, 33, 90, 200)], "series_key string, as_of timestamp"
    )
    known = {}
    for r in obs.collect():
        known.setdefault(r.series_key, []).append((r.observed_at, r.water_level_m))
    for width in (HOUR_US, 24 * HOUR_US, 10_000 * HOUR_US):
        got = forecast.asof_join(asked, obs, block_us=width).collect()
        assert len(got) == 21
        for r in got:
            past = [x for x in known.get(r.series_key, []) if x[0] <= r.as_of]
            want = max(past) if past else (None, None)
            assert (r.observed_at, r.water_level_m) == want
