from __future__ import annotations

import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import numbers, text, zones
from tidemark.operators import clean, quality

RAW = "series_key string, z_id string, time_d string, up_water_level string, row_position long"


def raw(spark, *rows):
    return spark.createDataFrame([("a", *r, i) for i, r in enumerate(rows)], RAW)


def test_rejects_are_counted_in_order_and_conserved(spark):
    rows = raw(
        spark,
        ("1", "2024-01-01 00:00:00", "3.0"),
        ("1", "2024-01-01 01:00:00", "3.5"),
        ("1", "2024-01-01 02:00:00", "bad"),
        (" ", "2024-01-01 00:00:00", ""),
        (None, "nonsense", "x"),
        ("2", "2024-01-01 25:00:00", "1"),
        ("3", "2024-01-01 00:00:00", ""),
        ("4", "2024-01-01 00:00:00", "NaN"),
        ("5", "2024-01-01 00:00:00", "Infinity"),
        ("6", "2024-01-01", "2_0.5"),
        ("7", "2024-01-01 05:00:00", "3.1d"),
    )
    got = clean.reject_counts(rows, F.col("row_position")).first()
    assert (got.total_rows, got.valid_rows, got.duplicate_rows) == (11, 2, 1)
    assert (got.invalid_timestamp_rows, got.missing_level_rows, got.invalid_level_rows) == (3, 2, 3)
    # Every stamp without a blank counts as date-only, so the unparsable word does too.
    assert got.conserved and got.date_only_rows == 2
    kept = {r.source_record_id: r for r in clean.normalise(rows, F.col("row_position")).collect()}
    assert kept["1"].water_level_m == 3.5, "the last valid row wins, not the last row"
    assert kept["6"].observed_at == dt.datetime(2024, 1, 1) and kept["6"].water_level_m == 20.5


def test_last_occurrence_ignores_validity_and_keeps_blank_ids(spark):
    rows = raw(spark, ("1", "t", "3"), (" 1 ", "t", ""), ("", "t", "1"), (None, "t", "2"))
    got = clean.last_occurrence(rows, F.col("row_position"), ["series_key"])
    assert sorted((r.z_id or "", r.up_water_level) for r in got.collect()) == [("", "1"), ("", "2"), (" 1 ", "")]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2024-03-10 01:59:59", True), ("2024-03-10 02:30:00", False), ("2024-03-10 03:00:00", True),
        ("2024-11-03 00:30:00", True), ("2024-11-03 01:30:00", False), ("2024-11-03 02:00:00", True),
        ("2024-03-10T02:30:00+00:00", True), ("2024-11-03T01:30:00-04:00", True),
    ],
)
def test_clock_change_times_are_refused_unless_the_offset_is_given(spark, value, expected):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    df = spark.createDataFrame([(value,)], "t string")
    got = text.with_timestamp(df, "t", "at").first()
    assert (got.at is not None) == expected


def test_only_zones_with_clock_changes_are_checked(spark):
    for zone, changes in (("Asia/Shanghai", True), ("UTC", False), ("+08:00", False)):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert bool(zones.changed_spans(zones.session_zone(spark))) is changes
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    df = spark.createDataFrame([("2024-06-01 01:30:00",)], "t string")
    assert text.with_timestamp(df, "t", "at").first()["at"] is not None


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Singapore", "Australia/Lord_Howe", "Pacific/Apia", "Europe/Lisbon"])
def test_wall_times_at_the_edges_of_every_change(spark, zone):
    """Refused is exactly what Python finds to have two offsets; Singapore once moved by 20 minutes, Lord Howe moves by 30, Apia lost a day."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    here = zoneinfo.ZoneInfo(zone)
    spans = zones.changed_spans(here)
    assert list(spans) == sorted(spans) and all(a < b for a, b in spans)
    walls = {dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s) for a, b in spans for s in (a - 1, a, (a + b) // 2, b - 1, b)}
    walls |= {dt.datetime(1933, 1, 1, 0, m) for m in (0, 19, 20)}
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M:%S"),) for w in walls if 1901 < w.year < 2099], "t string")
    for r in text.with_timestamp(df, "t", "at").select("t", F.col("at").isNotNull().alias("ok")).collect():
        w = dt.datetime.strptime(r.t, "%Y-%m-%d %H:%M:%S")
        assert r.ok == (w.replace(tzinfo=here, fold=0).utcoffset() == w.replace(tzinfo=here, fold=1).utcoffset()), r.t


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("1001.0", " TRUE ", 1.0, None), ("a.0", "0.0", 0.0, 2.0)], "i string, b string, x double, y double")
    got = df.select(
        text.record_id(F.col("i")).alias("plain"),
        text.record_id(F.col("i"), numeric_source=True).alias("number"),
        text.boolean_text(F.col("b")).alias("b"),
        numbers.share(F.col("y"), F.col("x")).alias("share"),
        numbers.differs(F.col("x"), F.col("y")).alias("d"),
        numbers.direction(F.col("x") - 0.5).alias("dir"),
    ).collect()
    assert [r.plain for r in got] == ["1001.0", "a.0"]
    assert [r.number for r in got] == ["1001", "a.0"]
    assert [r.b for r in got] == [True, False]
    assert got[1].share is None and all(r.d for r in got)
    assert [r.dir for r in got] == ["over", "under"]


def test_header_mapping(spark):
    df = spark.createDataFrame([("1", "t", "2", "x")], ['"id" ', "when", "level", "extra"])
    mapping = {"id": "z_id", "when": "time_d", "level": "up_water_level"}
    assert clean.map_headers(df, mapping).columns == ["z_id", "time_d", "up_water_level"]
    with pytest.raises(ValueError, match="up_water_level"):
        clean.map_headers(df.drop("level"), mapping)


def test_archive_counts(spark):
    rows = spark.createDataFrame(
        [("m1", "1"), ("m1", "2"), ("m2", "2"), ("m2", ""), ("m2", None)], "_member string, z_id string"
    )
    got = {r._member: r for r in clean.archive_counts(rows).collect()}
    assert (got["m1"].rows, got["m2"].rows) == (2, 3)
    assert (got[None].rows, got[None].unique_rows, got[None].duplicate_rows) == (5, 4, 1)


def test_selection_and_range(spark):
    df = spark.createDataFrame([("a",), ("b",)], "series_key string")
    with pytest.raises(ValueError, match="several"):
        clean.select_series(df)
    assert clean.select_series(df, "a").count() == 1
    with pytest.raises(ValueError, match="inverted"):
        clean.in_range(df, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))


def test_contract_rules(spark):
    good = spark.sql("select 'x' source_record_id, timestamp'2024-01-01' observed_at, 1.0D water_level_m, 'normal' quality_flag")
    quality.require_clean(good, schemas.observation_rules(), "observations")
    with pytest.raises(ValueError, match="non_finite_level"):
        quality.require_clean(good.withColumn("water_level_m", F.lit(float("nan"))), schemas.observation_rules(), "observations")
    points = spark.createDataFrame([("p", 200.0, 10.0), ("", 1.0, float("nan"))], "point_id string, longitude double, latitude double")
    got = quality.check_rows(points, schemas.point_rules()).first()
    assert (got.blank_point, got.bad_longitude, got.bad_latitude) == (1, 1, 1)


def test_offsets(spark):
    same = spark.createDataFrame([("2024-01-01T00:00:00+08:00",), ("2024-01-01T01:00:00+08:00",)], "t string")
    assert quality.require_uniform_offset(same, "t").first().t == dt.datetime(2023, 12, 31, 16)
    for other in ("2024-01-01T00:00:00+09:00", "2024-01-01 00:00:00"):
        mixed = same.union(spark.createDataFrame([(other,)], "t string"))
        with pytest.raises(ValueError, match="one UTC offset"):
            quality.require_uniform_offset(mixed, "t")
