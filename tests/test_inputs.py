"""Odd spellings in raw text, and values whose distribution is far from even."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, timeline
from tidemark.operators import forecast, grid, quantiles

UTC = dt.timezone.utc


@pytest.mark.parametrize(
    "given,want",
    [
        ("2026/01/01 08:00:00", "2026-01-01 08:00:00"),
        ("Jan 1 2026 08:00", "2026-01-01 08:00:00"),
        ("January 12, 2026", "2026-01-12 00:00:00"),
        ("20260101 08:00", "2026-01-01 08:00:00"),
        ("2026-01-01T080000", "2026-01-01 08:00:00"),
        ("20260101T0805", "2026-01-01 08:05:00"),
        ("2026-01-01T08:00+08", "2026-01-01 00:00:00"),
        ("2026-01-01T08:00:00+0800", "2026-01-01 00:00:00"),
        ("2026-01-01T08:00:00Z", "2026-01-01 08:00:00"),
        ("2026-W01-1", "2025-12-29 00:00:00"),
        ("2026-W01", "2025-12-29 00:00:00"),
        ("01/31/2026 5:06", "2026-01-31 05:06:00"),
        ("　2026-01-01\t", "2026-01-01 00:00:00"),
        ("1 Jan 2026 08:00", "2026-01-01 08:00:00"),
        ("01-Jan-2026", "2026-01-01 00:00:00"),
        ("Jan 1, 2026 8:00 AM", "2026-01-01 08:00:00"),
        ("2026-01-01 08:00 PM", "2026-01-01 20:00:00"),
        ("2026.01.01 08:00", "2026-01-01 08:00:00"),
        ("2026-01-01T08+08", "2026-01-01 00:00:00"),
        ("Thu, 01 Jan 2026 08:00:00 +0000", "2026-01-01 08:00:00"),
        ("31/01/2026 12:05 am", "2026-01-31 00:05:00"),
        ("2026-01-01T08:00:00.123456789+05:30", "2026-01-01 02:30:00"),
        ("2026-01-01 08:00 GMT", "2026-01-01 08:00:00"),
        ("2026-1-2 3:04", "2026-01-02 03:04:00"),
        ("2026-01-01 13:00 PM", None),
        ("2026-02-30", None),
        ("2026-13-01 08:00", None),
        ("32 Jan 2026", None),
        ("2026-01-01 08:00 nonsense", None),
        ("2026-01-01 25:00:00", None),
        ("12:30", None),
        ("Jux 1 2026", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_times(spark, given, want):
    rows = text.with_timestamp(spark.createDataFrame([(given,)], "t string"), "t", "out")
    assert rows.select(F.date_format("out", "yyyy-MM-dd HH:mm:ss")).first()[0] == want


@pytest.mark.parametrize(
    "given,want", [("1.0000001E7", "10000001"), ("7.0", "7"), ("1.5E7", "15000000"), ("\t7　", "7"), ("1.25", "1.25"), ("nan", None), ("\t", None), ("-2E8", "-200000000"), ("x1E7", "x1E7")]
)
def test_numeric_ids(spark, given, want):
    df = spark.createDataFrame([(given,)], "i string")
    assert df.select(text.record_id(F.col("i"), numeric_source=True)).first()[0] == want


def test_quantiles_leave_few_values_to_order(spark):
    rng = np.random.default_rng(1)
    columns = {
        "outliers": np.concatenate((rng.uniform(size=20000), [1e6, 1e12])),
        "lognormal": rng.lognormal(0, 8, 20000),
        "pareto": rng.pareto(0.3, 20000),
        "signed": rng.normal(size=20000) ** 3,
        "nested": np.concatenate((1 + 1e-12 * rng.uniform(size=20000), [1e300, 1.2, 1.0001, 1.0000001])),
        "repeated": np.concatenate((np.full(15000, 3.0), rng.uniform(size=5000))),
    }
    rows = [(k, float(v)) for k, vs in columns.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", F.col("v").alias("_v")).agg(F.count("*").alias("_n")).cache()
    span = counts.groupBy("k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("n"), F.count("*").alias("_left"))
    state = span.select("k", "n", "_lo", "_hi", "_left", F.lit(0).cast("long").alias("_before"), F.lit(0.5).alias("quantile"), F.lit(10000).cast("long").alias("_rank"))
    once = quantiles._narrowed(counts, state, ["k"], 64)
    assert max(r["_left"] for r in once.collect()) <= 20001 * 0.06
    state = quantiles.located(counts, state, ["k"], 64, 64)
    left = counts.join(state, "k").where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy("k").count()
    assert max(r["count"] for r in left.collect()) <= 64
    got = {(r.k, r.quantile): r.value for r in quantiles.exact_quantiles(df, "v", [0.0, 0.5, 0.99, 1.0], ["k"], most=64).collect()}
    for (k, q), value in got.items():
        assert np.isclose(value, np.quantile(columns[k], q), rtol=1e-12)


def test_latest_reading_of_one_moment(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [("a", at, v, str(v)) for v in (2.0, 9.0, 4.0)]
    obs = spark.createDataFrame(rows, "series_key string, observed_at timestamp, water_level_m double, source_record_id string")
    assert forecast.latest_before(obs).first().water_level_m == 9.0
    assert [r.water_level_m for r in forecast.latest_before(obs, n=2).collect()] == [9.0, 4.0]


def test_moment_outside_the_zone_grid_fails(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    obs = "series_key string, observed_at timestamp, water_level_m double"
    day = lambda y: dt.datetime(y, 7, 1, 3, tzinfo=UTC)
    assert grid.bucket_last(spark.createDataFrame([("a", day(2020), 1.0)], obs), "1d").count() == 1
    with pytest.raises(Exception, match="no grid of this step"):
        grid.bucket_last(spark.createDataFrame([("a", day(1988), 1.0)], obs), "1d").collect()
    assert timeline.zone_shift(spark, 24 * timeline.HOUR_US) == 8 * timeline.HOUR_US


def test_ridge_runs_where_workers_lack_the_package(tmp_path):
    """Python tasks of a session started elsewhere need nothing installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        f"""import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
from tidemark.operators import models
rows = [("a", "train", 1, [float(i), float(i * i % 7)], 2.0 * i) for i in range(30)]
df = spark.createDataFrame(rows, "series_key string, segment string, horizon int, x array<double>, y double")
print(models.fit_ridge(df).count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split()[-1:] == ["4"], out.stderr[-2000:]


def test_plain_times_are_parsed_as_they_stand(spark):
    """Every form of the fast path is read alike by the table of spellings."""
    forms = ["2026-01-05", "2026-01-05 06:07", "2026-01-05T06:07", "2026-01-05 06:07:08", "2026-01-05T06:07:08.9", "2026-01-05 06:07:08.123456", "2026-01-05T06:07:08Z", "2026-01-05T06:07:08.5+08:00", "2026-01-05 06:07:08-03:30"]
    df = spark.createDataFrame([(f,) for f in forms], "t string").withColumn("padded", F.concat(F.lit(" "), "t", F.lit("  ")))
    rows = text.with_timestamp(text.with_timestamp(df, "t", "a"), "padded", "b").collect()
    assert all(r.a is not None and r.a == r.b for r in rows)
