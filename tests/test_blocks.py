from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, events, forecast, quality

START = dt.datetime(2024, 1, 1)
DAY_US = 86_400_000_000


def crowded(rows=3000, seed=1):
    """``(key, time)``: one series has a third of all rows within one hour of one day, the rest are spread over a year."""
    rng = np.random.default_rng(seed)
    burst = {START + dt.timedelta(days=40, microseconds=int(u)) for u in rng.integers(0, 3_600_000_000, rows // 3)}
    spread = {(f"s{i % 5}", START + dt.timedelta(seconds=int(u))) for i, u in enumerate(rng.integers(0, 365 * 86_400, rows * 2 // 3))}
    return sorted({("s0", t) for t in burst} | spread)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    return spark.createDataFrame(
        [(k, t, float(v)) for (k, t), v in zip(crowded(), rng.normal(size=3001))], "series_key string, observed_at timestamp, water_level_m double"
    ).cache()


def sizes(df):
    return {(r.series_key, r["_block"]): (r.n, r.lo, r.hi) for r in df.groupBy("series_key", "_block").agg(F.count("*").alias("n"), F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi")).collect()}


@pytest.mark.parametrize("most", [1, 20, 250, 100_000])
def test_no_block_holds_more_than_asked(spark, rows, most):
    placed = blocks.equal_blocks(rows, ["series_key"], "observed_at", DAY_US, most)
    assert placed.count() == rows.count() and set(placed.columns) == {*rows.columns, "_block"}
    found = sizes(placed)
    assert max(n for n, _, _ in found.values()) <= most
    # Blocks follow one another in time.
    for key in {k for k, _ in found}:
        own = [found[kb] for kb in sorted(kb for kb in found if kb[0] == key)]
        assert all(a[2] < b[1] for a, b in zip(own, own[1:]))


def test_ties_nulls_and_no_rows(spark):
    same = [("a", START)] * 50 + [(None, START)] * 50 + [("a", None)] * 50
    df = spark.createDataFrame(same, "series_key string, observed_at timestamp")
    got = blocks.equal_blocks(df, ["series_key"], "observed_at", DAY_US, 10)
    assert got.count() == 150 and got.filter("_block is null").count() == 50
    assert blocks.equal_blocks(df.limit(0), ["series_key"], "observed_at", DAY_US, 10).count() == 0


def test_few_crowded_slots_are_told(spark, rows, monkeypatch):
    """The table of crowded slots is bounded: blocks grow instead."""
    monkeypatch.setattr(blocks, "CROWDED", 10)
    found = sizes(blocks.equal_blocks(rows, ["series_key"], "observed_at", DAY_US, 1))
    assert 1 < max(n for n, _, _ in found.values()) <= -(-rows.count() // 10)


@pytest.mark.parametrize("width", [86_400_000_000, 3_600_000_000, 4096 * 3_600_000_000, 997, 64, 1])
def test_widths_nest(width):
    while width > 1:
        narrow = blocks.finer(width)
        assert width % narrow == 0 and narrow < width
        width = narrow


def test_values_do_not_depend_on_the_block(spark, rows):
    last = dt.datetime(2025, 1, 1)
    told = rows.select(
        "series_key", F.lit("m").alias("model"), F.lit(1).alias("horizon"), F.lit("test").alias("segment"), F.col("observed_at").alias("target"),
        F.col("water_level_m").alias("observed"), (F.col("water_level_m") + 0.1).alias("prediction"),
    )
    asked = spark.createDataFrame([(f"s{i % 6}", START + dt.timedelta(hours=37 * i, microseconds=i)) for i in range(200)], "series_key string, as_of timestamp")
    results = []
    for most in (5, 100, 100_000):
        gaps = sorted(map(tuple, quality.sampling_interval(rows, block_rows=most).collect()))
        phases = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in events.phase_errors(told, START, last, block_rows=most).collect())
        change = sorted(map(tuple, events.largest_change(told, START, last, block_rows=most).collect()))
        seen = sorted(map(str, forecast.asof_join(asked, rows, block_rows=most).collect()))
        results.append((gaps, phases, change, seen))
    assert results[0] == results[1] == results[2]
    table = {}
    for r in rows.collect():
        table.setdefault(r.series_key, []).append((r.observed_at, r.water_level_m))
    gaps = {}
    for k, v in table.items():
        at = sorted(t for t, _ in v)
        gaps[k] = [(b - a).total_seconds() for a, b in zip(at, at[1:])]
    for r in results[0][0]:
        assert r[2] == pytest.approx(np.median(gaps[r[0]])) and r[3] == pytest.approx(min(gaps[r[0]])) and r[4] == pytest.approx(max(gaps[r[0]]))


def test_as_of_with_several_observations_of_one_moment(spark):
    t = START
    obs = spark.createDataFrame([("a", t, 1.0), ("a", t, 3.0), ("a", t, 2.0), ("a", t - dt.timedelta(days=2), 9.0)], "series_key string, observed_at timestamp, water_level_m double")
    asked = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(days=3)), ("a", t - dt.timedelta(days=1)), ("a", t - dt.timedelta(days=9)), ("b", t)], "series_key string, as_of timestamp")
    for most in (1, 1000):
        got = {(r.series_key, r.as_of): r.water_level_m for r in forecast.asof_join(asked, obs, block_rows=most).collect()}
        assert list(got[k] for k in sorted(got)) == [None, 9.0, 3.0, 3.0, None]


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_gap_statistics_count_every_kind_of_row(spark, width):
    """Missing rows, infinite ones, and two rows of one stamp, whatever the blocks."""
    level = [1.0, None, None, 2.0, float("inf"), None, 3.0, None, None, None, 4.0, float("nan"), None]
    rows = [("a", i, START + dt.timedelta(hours=i), v) for i, v in enumerate(level)] + [("a", 3, START + dt.timedelta(hours=3), 2.5), ("b", 0, START, 1.0)]
    df = spark.createDataFrame(rows, "series_key string, grid_pos long, observed_at timestamp, water_level_m double")
    got = {r.series_key: r for r in quality.gap_statistics(df, block_steps=width).collect()}
    a, b = got["a"], got["b"]
    assert (a.expected_buckets, a.observed_buckets, a.missing_buckets, a.total_missing_steps) == (14, 7, 7, 7)
    assert (a.duplicate_timestamps, a.non_finite_values, a.gap_segments, a.longest_gap) == (1, 9, 4, 3)
    assert (a.gap_p50, a.longest_gap_start, a.first_at, a.last_at) == (1.5, START + dt.timedelta(hours=7), START, START + dt.timedelta(hours=12))
    assert (b.expected_buckets, b.missing_buckets, b.gap_segments, b.gap_p50, b.longest_gap_start) == (1, 0, 0, None, None)


def test_gap_statistics_read_the_grid_once(spark):
    df = spark.range(1000).selectExpr("'a' AS series_key", "id AS grid_pos", "timestamp_seconds(id * 3600) AS observed_at", "if(id % 7 < 2, null, 1D) AS water_level_m")
    df.write.mode("overwrite").saveAsTable("one_grid")
    try:
        frame = quality.gap_statistics(spark.table("one_grid"))
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("FileScan") == 1
    finally:
        spark.sql("DROP TABLE one_grid")
