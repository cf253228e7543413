from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import HOUR, START, brute_grid, null, observations, random_series
from tidemark.functions import timeline
from tidemark.operators import blocks, grid, quality


def rows(df, *order):
    return df.orderBy(*order).collect()


def test_bucket_keeps_last_observation_and_its_columns(spark):
    obs = observations(spark, {"a": {0.0: 1.0, 0.25: 2.0, 0.75: 3.0, 1.5: 4.0}})
    got = rows(grid.bucket_last(obs), "observed_at")
    assert [(r.observed_at, r.water_level_m, r.source_record_id) for r in got] == [
        (START, 3.0, "a-0.75"), (START + HOUR, 4.0, "a-1.5")
    ]


def test_tie_inside_a_bucket_takes_the_later_position(spark):
    obs = observations(spark, {"a": {0.5: 1.0}}).withColumn("row_position", F.lit(1))
    later = obs.withColumn("water_level_m", F.lit(9.0)).withColumn("row_position", F.lit(2))
    assert grid.bucket_last(obs.unionByName(later)).first().water_level_m == 9.0


GAPPED = {0: 3.00, 1: 3.10, 5: 3.50, 6: 3.60, 11: 4.10, 12: 4.20}


@pytest.mark.parametrize("steps,imputed", [(0, 0), (2, 0), (3, 3), (4, 7)])
def test_only_short_inner_gaps_are_filled(spark, steps, imputed):
    got = rows(grid.resample(observations(spark, {"a": GAPPED}), max_steps=steps), "grid_pos")
    assert len(got) == 13
    assert sum(r.is_imputed for r in got) == imputed
    if steps >= 3:
        assert [round(got[i].water_level_m, 6) for i in (2, 3, 4)] == [3.2, 3.3, 3.4]
        assert {got[i].quality_flag for i in (2, 3, 4)} == {"imputed"}
        assert got[2].source_record_id is None
    assert got[0].quality_flag == "normal"


@pytest.mark.parametrize("block_steps", [7, 16, 4096])
@pytest.mark.parametrize("max_steps", [0, 1, 3, 40])
def test_grid_equals_brute_force_for_any_block_size(spark, block_steps, max_steps):
    data = {f"s{i}": random_series(i, keep=k) for i, k in enumerate((0.9, 0.5, 0.15))}
    got = grid.chronological_split(
        grid.resample(observations(spark, data), max_steps=max_steps, block_steps=block_steps)
    )
    for key, series in data.items():
        mine = rows(got.filter(F.col("series_key") == key), "grid_pos")
        want = brute_grid(series, max_steps)
        assert [r.observed_at for r in mine] == list(want.observed_at)
        assert [r.is_imputed for r in mine] == list(want.imputed)
        assert [r.segment for r in mine] == list(want.segment)
        for r, w in zip(mine, want.level):
            w = null(w)
            assert (r.water_level_m is None) == (w is None)
            assert w is None or abs(r.water_level_m - w) < 1e-9


def test_one_series_alone_equals_the_same_series_among_many(spark):
    data = {f"s{i}": random_series(i) for i in range(4)}
    many = grid.resample(observations(spark, data), max_steps=2).filter("series_key = 's2'")
    alone = grid.resample(observations(spark, {"s2": data["s2"]}), max_steps=2)
    assert many.exceptAll(alone).count() == 0 and alone.exceptAll(many).count() == 0


def test_fill_of_a_stored_grid_equals_resample(spark):
    obs = observations(spark, {"a": random_series(3, keep=0.6)})
    whole = grid.resample(obs, max_steps=2).drop("grid_pos", "grid_len")
    base = grid.complete_grid(obs)
    stepwise = grid.fill_short_gaps(base, 2, block_steps=8).select(*whole.columns)
    assert whole.exceptAll(stepwise).count() == 0
    restored = grid.with_grid_position(base.drop("grid_pos", "grid_len"))
    assert restored.select(*base.columns).exceptAll(base).count() == 0


def test_day_steps_follow_the_local_calendar(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    obs = spark.sql(
        "select 'a' series_key, 'x' source_record_id, 1.0D water_level_m, "
        "explode(array(timestamp'2024-01-01 00:30:00', timestamp'2024-01-02 23:00:00')) observed_at"
    )
    got = grid.resample(obs, "1d", max_steps=0).select(F.col("observed_at").cast("string").alias("t"))
    assert sorted(r.t for r in got.collect()) == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]


def test_day_steps_are_refused_where_offsets_change(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    with pytest.raises(ValueError, match="no fixed grid"):
        timeline.zone_shift(spark, timeline.step_micros("1d"))
    assert timeline.zone_shift(spark, timeline.step_micros("1h")) == 0


@pytest.mark.parametrize("bad", ["", "1", "0h", "1month", None])
def test_step_alias_is_checked(bad):
    with pytest.raises(ValueError):
        timeline.step_micros(bad)


@pytest.mark.parametrize("hours,sizes", [(7, (4, 1, 2)), (12, (8, 1, 3)), (100, (70, 15, 15))])
def test_split_sizes_are_floors(spark, hours, sizes):
    obs = observations(spark, {"a": {h: 3.0 + 0.01 * h for h in range(hours)}})
    split = grid.chronological_split(grid.resample(obs, max_steps=0))
    counts = {r.segment: r["count"] for r in split.groupBy("segment").count().collect()}
    assert tuple(counts[s] for s in grid.SEGMENTS) == sizes
    assert grid.require_splittable(split) is split


def test_too_short_series_is_reported(spark):
    obs = observations(spark, {"a": {h: 1.0 for h in range(6)}, "b": {h: 1.0 for h in range(9)}})
    split = grid.chronological_split(grid.resample(obs, max_steps=0))
    assert [r.series_key for r in grid.unsplittable_series(split).collect()] == ["a"]
    with pytest.raises(ValueError, match="at least 7"):
        grid.require_splittable(split)


@pytest.mark.parametrize("ratios", [(0.0, 0.1), (1.0, 0.1), (0.7, 0.3), (0.9, 0.2)])
def test_bad_ratios_are_refused(spark, ratios):
    with pytest.raises(ValueError):
        grid.chronological_split(spark.range(1), *ratios)


def test_no_part_is_empty_over_a_ratio_grid(spark):
    obs = observations(spark, {f"s{n}": {h: 1.0 for h in range(n)} for n in (7, 8, 13, 20)})
    levels = grid.resample(obs, max_steps=0).cache()
    for train in (0.5, 0.6, 0.7):
        for validation in (0.15, 0.2):
            split = grid.chronological_split(levels, train, validation)
            parts = split.filter("segment is not null").groupBy("series_key").agg(
                F.count_distinct("segment").alias("n")
            )
            assert {r.n for r in parts.collect()} == {3}
    levels.unpersist()


@pytest.mark.parametrize("block_steps", [9, 4096])
def test_sweep_equals_one_fill_per_threshold(spark, block_steps):
    obs = observations(spark, {f"s{i}": random_series(i, keep=0.6) for i in range(3)})
    base = grid.complete_grid(obs)
    sweep = {
        (r.series_key, r.max_steps): r
        for r in grid.interpolation_sweep(base, block_steps=block_steps).collect()
    }
    for n in (0, 1, 2, 3, 6):
        levels = grid.fill_short_gaps(base, n)
        usable = {r.series_key: r for r in quality.usable_samples(levels).collect()}
        for r in levels.groupBy("series_key").agg(
            F.count_if("is_imputed").alias("i"), F.count_if(F.col("water_level_m").isNull()).alias("m")
        ).collect():
            s = sweep[(r.series_key, n)]
            assert (s.imputed_rows, s.remaining_missing) == (r.i, r.m)
            assert (s.usable_h1, s.usable_h3, s.usable_h6) == tuple(usable[r.series_key][f"usable_h{h}"] for h in (1, 3, 6))


def test_sweep_looks_ahead_once_for_each_horizon(spark):
    base = grid.complete_grid(observations(spark, {"a": random_series(1)}), "1h")
    plan = grid.interpolation_sweep(base)._jdf.queryExecution().optimizedPlan().toString()
    # Three horizons and the next observed row, whatever the number of thresholds.
    assert 0 < plan.count("lead(") <= 4


def test_spread_makes_every_integer_once(spark):
    bounds = spark.createDataFrame([("a", -5, 40), ("b", 7, 7)], "k string, lo long, hi long")
    got = blocks.spread_steps(bounds, ["k"], "lo", "hi", "i", block_steps=8)
    assert sorted((r.k, r.i) for r in got.collect()) == [("a", i) for i in range(-5, 41)] + [("b", 7)]


def test_step_index_floors_before_the_epoch(spark):
    row = spark.sql("select timestamp'1969-12-31 23:30:00' t").select(
        timeline.step_index(F.col("t"), timeline.HOUR_US).alias("i"),
        timeline.shift_steps(F.col("t"), 2, timeline.HOUR_US).alias("s"),
    ).first()
    assert row.i == -1 and row.s == dt.datetime(1970, 1, 1, 1, 30)
