from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from helpers import HOUR, START
from tidemark import schemas
from tidemark.operators import clean
from tidemark.sinks import digests, tables
from tidemark.sources import archives, files, responses
from workload import composites


def test_raw_files_by_suffix(spark, tmp_path):
    (tmp_path / "r.csv").write_text("time_d,up_water_level,z_id\n2026-01-01 00:00:00,3.10,1001\n2026-01-01 01:00:00,,1002\n")
    got = files.read_raw(spark, str(tmp_path / "r.csv")).orderBy(files.input_position()).collect()
    assert [(r.z_id, r.up_water_level) for r in got] == [("1001", "3.10"), ("1002", None)]
    spark.createDataFrame([(1, 3.5)], "z_id long, up_water_level double").write.parquet(str(tmp_path / "r.parquet"))
    assert files.read_raw(spark, str(tmp_path / "r.parquet")).first().up_water_level == "3.5"
    (tmp_path / "r.json").write_text(json.dumps([{"z_id": 1, "time_d": "t", "up_water_level": 2.5, "note": "n"}, {"z_id": "2"}]))
    got = files.read_raw(spark, str(tmp_path / "r.json")).orderBy("_pos").collect()
    assert [(r.z_id, r.up_water_level) for r in got] == [("1", "2.5"), ("2", None)]
    with pytest.raises(ValueError, match="no reader"):
        files.read_raw(spark, str(tmp_path / "r.xlsx"))


@pytest.mark.parametrize("text,message", [('{"z_id": 1}', "not a JSON array"), ("[1, 2]", "not an object"), ('[{"z_id": 1}, 2]', "not an object"), ("nonsense", "not a JSON array")])
def test_json_must_hold_objects(spark, tmp_path, text, message):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match=message):
        files.read_raw(spark, str(tmp_path / "bad.json")).collect()


def gbk_zip(members: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text.encode("gbk"))
    return buffer.getvalue()


def test_json_numbers_stand_as_written_and_files_are_whole_records(spark, tmp_path, monkeypatch):
    folder = tmp_path / "r.json"
    folder.mkdir()
    (folder / "a.json").write_text('\n[{"z_id": 1.10, "up_water_level": 1E400,\n "note": {"a": [2.00]}},\n {"z_id": -0}]', encoding="utf-8")
    (folder / "b.json").write_text('[{"z_id": "水", "up_water_level": 12345678901234567890123}, {"z_id": null}]', encoding="utf-8")
    (folder / "c.json").write_text("[]")
    want = {("1.10", "1E400", '{"a":["2.00"]}'), ("-0", None, None), ("水", "12345678901234567890123", None), (None, None, None)}
    for most in (files.RECORD_BYTES, 0):
        monkeypatch.setattr(files, "RECORD_BYTES", most)
        got = files.read_raw(spark, str(folder))
        assert {(r.z_id, r.up_water_level, r.note) for r in got.collect()} == want


def test_records_are_written_in_files_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(composites, "STRETCH_BITS", 6)
    kinds = "event_id long, event_type string, user_id long, props string"
    rows = [(i if i % 3 else None, "t", i if i % 2 else None, None) for i in range(1000)]
    arrays = [json.loads(r.value) for r in composites.json_arrays(spark.createDataFrame(rows, kinds).coalesce(2)).collect()]
    assert max(map(len, arrays)) <= 64 and len(arrays) <= 1000 // 64 + 2 * 8
    assert sorted((x.get("z_id", -1), x.get("station_code", -1)) for a in arrays for x in a) == sorted(
        (i if i % 3 else -1, i if i % 2 else -1) for i in range(1000)
    )


def test_archive_is_recognised_by_content_and_merged(spark, tmp_path):
    (tmp_path / "official.csv").write_bytes(
        gbk_zip(
            {
                "1.csv": "监测时间,实时水位,主键\n2022-06-02 00:00:00,3.1,7\n2022-06-02 00:00:30,3.2,8\n",
                "2.csv": '主键,"监测时间",实时水位,备注\n8,2022-06-02 00:00:30,,x\n,2022-06-02 00:01:00,3.3,y\n9,2022-06-02 00:01:30,3.4,z\n',
                "readme.txt": "x",
            }
        )
    )
    rows = archives.read_shards(spark, str(tmp_path))
    assert rows.count() == 5
    merged = archives.merged_shards(rows)
    assert sorted((r.z_id or "", r.up_water_level) for r in merged.collect()) == [("", "3.3"), ("7", "3.1"), ("8", ""), ("9", "3.4")]
    counts = {r._member: r for r in clean.archive_counts(rows).collect()}
    assert (counts["2.csv"].rows, counts[None].duplicate_rows) == (3, 1)


def test_archive_errors(spark, tmp_path):
    for name, content, message in (
        ("a", gbk_zip({"1.csv": "监测时间,主键\nx,1\n"}), "up_water_level"),
        ("b", gbk_zip({"1.txt": "x"}), "no CSV shard"),
        ("c", b"\xff\xff\xff,\n", "decode"),
    ):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "f.csv").write_bytes(content)
        with pytest.raises(Exception, match=message):
            archives.read_shards(spark, str(folder)).collect()


def test_members_of_one_archive_are_tasks_of_their_own(spark, tmp_path):
    line = "2022-06-02 00:00:00,3.1,{}\n"
    members = {f"{m:02}.csv": "监测时间,实时水位,主键\n" + "".join(line.format(m * 1000 + i) for i in range(300)) for m in range(40)}
    (tmp_path / "big.zip").write_bytes(gbk_zip(members))
    rows = archives.read_shards(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r._member_no, r._pos, r.z_id) for r in rows) == [(m, i, str(m * 1000 + i)) for m in range(40) for i in range(300)]
    assert len({r.task for r in rows}) > 1


def test_packed_shards_come_back(spark):
    table = spark.range(500).selectExpr(
        "concat('a', id % 3) AS archive", "concat(id % 7, '.csv') AS member", "id AS _pos", "cast(id AS string) AS z_id",
        "if(id % 5 = 0, null, '水位,\"x\"') AS up_water_level", "'2022-06-02 00:00:00' AS time_d",
    )
    back = archives.unpack_shards(archives.pack_shards(table, "archive", "member"))
    got = sorted((r._file, r._member, r.z_id, r.up_water_level or None) for r in back.collect())
    assert got == sorted((r.archive, r.member, r.z_id, r.up_water_level) for r in table.collect())


def test_damaged_members_fail(spark):
    good = gbk_zip({"1.csv": "监测时间,实时水位,主键\nx,1,7\n"})
    bad = good.replace(b"x,1,7", b"x,1,8")
    assert good != bad
    with pytest.raises(Exception, match="damaged"):
        archives.unpack_shards(spark.createDataFrame([("a.zip", bytearray(bad))], "path string, content binary")).collect()


def test_extracted_shards(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("监测时间,实时水位,主键\n2022-06-02,3.1,7\n".encode("gbk"))
    rows = archives.read_extracted_shards(spark, str(tmp_path / "s.csv"))
    assert clean.map_headers(rows, archives.SHARD_HEADERS).first().z_id == "7"


RAIN_HEADER = "observed_at,precipitation_mm,rain_mm,point_id,longitude,latitude\n"


def test_rain_directory(spark, tmp_path):
    for point in ("p1", "p2"):
        (tmp_path / point).mkdir()
        (tmp_path / point / "2024.csv").write_text(RAIN_HEADER + f"2024-01-01T00:00:00+08:00,1.5,1.0, {point},1,2\n")
    rows = files.read_rain_points(spark, str(tmp_path))
    assert sorted(r.point_id for r in rows.collect()) == ["p1", "p2"]
    (tmp_path / "p2" / "2025.csv").write_text("observed_at,rain_mm\n2024-01-01T00:00:00+08:00,1\n")
    with pytest.raises(Exception, match="2025.csv"):
        files.read_rain_points(spark, str(tmp_path)).collect()


def test_level_table_round_trip(spark, tmp_path):
    grid = spark.createDataFrame(
        [("a", START, 3.0, False, "normal", "1", None, None), ("a", START + HOUR, float("nan"), True, None, None, None, None)], schemas.GRID
    )
    tables.write_contract_csv(grid, str(tmp_path / "g"))
    back = files.read_levels(spark, str(tmp_path / "g"), schemas.GRID).orderBy("observed_at").collect()
    assert [(r.observed_at, r.water_level_m, r.is_imputed) for r in back] == [(START, 3.0, False), (START + HOUR, None, True)]
    text = spark.read.text(str(tmp_path / "g")).filter(F.col("value").contains("3.000000")).first().value
    assert text.startswith("a,2024-01-01T00:00:00Z,3.000000,false")
    tables.write_table(grid.drop("quality_flag"), str(tmp_path / "p"))
    with pytest.raises(ValueError, match="quality_flag"):
        files.read_levels(spark, str(tmp_path / "p"), schemas.GRID, "parquet")
    tables.write_contract_csv(grid.withColumn("is_imputed", F.lit("maybe")), str(tmp_path / "h"))
    with pytest.raises(Exception, match="not a boolean"):
        files.read_levels(spark, str(tmp_path / "h"), schemas.GRID).collect()


def test_predictions_must_be_complete(spark, tmp_path):
    for segment in ("train", "validation", "test"):
        for h in (1, 3):
            folder = tmp_path / "E1"
            folder.mkdir(exist_ok=True)
            (folder / f"ridge_h{h}_{segment}.csv").write_text(f"observed_at,segment,observed,prediction\n2024-01-01T00:00:00+00:00,{segment},1.0,\n")
    read = lambda hs: files.read_predictions(spark, str(tmp_path), experiments=["E1"], models=["ridge"], horizons=hs)
    got = read((1, 3)).collect()
    assert len(got) == 6 and {r.model for r in got} == {"ridge_E1"}
    assert all(r.target - r.anchor == r.horizon * HOUR and r.prediction is None for r in got)
    with pytest.raises(ValueError, match="missing"):
        read((1, 3, 6))


def test_artifacts_skip_malformed_files(spark, tmp_path):
    good = {"model": "ridge", "model_version": "v", "as_of": "2024-01-01T00:00:00+00:00", "anchor_at": "2024-01-01T00:00:00+00:00",
            "points": [{"horizon": 1, "target_at": "2024-01-01T01:00:00+00:00", "water_level_m": 3.5}]}
    (tmp_path / "ridge_h1.json").write_text(json.dumps(good))
    (tmp_path / "ridge.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps({**good, "as_of": "never"}))
    got = files.read_artifacts(spark, str(tmp_path), {"ridge_h1.json": 1, "ridge.json": 2, "other.json": 3}, {"series_key": "a"}).collect()
    assert [(r.series_key, r.priority, r.points[0].water_level_m) for r in got] == [("a", 1, 3.5)]
    assert got[0].points[0].target_at == START + HOUR


def response(spark, **hourly):
    return spark.createDataFrame([("p", json.dumps({"latitude": 1.0, "hourly": hourly}))], "point_id string, body string").select(
        "point_id", F.from_json("body", schemas.ARCHIVE_RESPONSE).alias("r")
    ).select("point_id", "r.*")


@pytest.mark.parametrize(
    "hourly,reason",
    [
        ({"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [1, 2], "rain": [1, None]}, None),
        ({"time": ["2024-01-01T00:00"], "precipitation": [1.0, 2.0], "rain": [1.0]}, "length_precipitation"),
        ({"time": ["2024-01-01T01:00", "2024-01-01T01:00"], "precipitation": [1, 2], "rain": [1, 2]}, "time_not_increasing"),
        ({"time": ["2024-01-01T00:00"], "precipitation": [1.0]}, "missing_rain"),
        ({"time": ["x"], "precipitation": [1.0], "rain": [1.0]}, "unparsable_time"),
        ({"precipitation": [1.0]}, "missing_time"),
        ({"time": ["2024-01-01T00:00"], "precipitation": [1.0], "rain": [1.0]}, None),
    ],
)
def test_response_checks(spark, hourly, reason):
    df = response(spark, **hourly)
    got = [r.violation for r in responses.response_violations(df).collect()]
    assert got == ([reason] if reason else [])
    if reason is None:
        rows = responses.response_rows(df, ["point_id", "latitude"], ["rain"]).orderBy("observed_at").collect()
        assert len(rows) == len(hourly["time"]) and rows[0].rain_mm == 1.0 and rows[0].precipitation_mm is None


def test_responses_are_read_from_files(spark, tmp_path):
    body = {"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00"], "precipitation": [1.0], "rain": [0.5]}}
    (tmp_path / "r.json").write_text(json.dumps(body))
    assert responses.response_rows(responses.read_responses(spark, str(tmp_path)), ["latitude"]).first().rain_mm == 0.5
    with pytest.raises(ValueError, match="unsupported"):
        responses.response_rows(response(spark, time=[]), [], ["snow"])


def test_pages_stop_at_the_total_and_at_the_first_empty_page(spark):
    pages = spark.createDataFrame(
        [("d", 1, 5, ["a", "b"]), ("d", 2, 5, ["c", "d"]), ("d", 3, 5, ["e", "f"]), ("e", 1, 9, ["x"]), ("e", 2, 9, []), ("e", 3, 9, ["y"])],
        "dataset_id string, page int, total int, data array<string>",
    )
    got = sorted((r.dataset_id, r.page, r.row) for r in responses.paged_rows(pages).collect())
    assert got == [("d", 1, "a"), ("d", 1, "b"), ("d", 2, "c"), ("d", 2, "d"), ("d", 3, "e"), ("e", 1, "x")]


def test_snapshot_is_immutable_and_digest_is_order_free(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2.0), ("2", float("nan")), ("2", float("nan"))], "id string, v double")
    other = rows.orderBy(F.desc("id")).repartition(3)
    assert digests.content_digest(rows).first() == digests.content_digest(other).first()
    assert digests.content_digest(rows).first() != digests.content_digest(rows.distinct()).first()
    write = lambda: tables.write_snapshot(
        rows, str(tmp_path), dataset_id="d", source_name="s", acquired_at=dt.datetime(2024, 5, 1), parameters={"page": 1}
    )
    manifest = write().first()
    assert manifest.record_count == 3 and "/d/2024-05-01/" in manifest.path
    assert '{"id":"2","v":null}' in [r.value for r in spark.read.text(manifest.path).collect()]
    with pytest.raises(Exception, match="(?i)already exists"):
        write()


def test_results_and_file_digests(spark, tmp_path):
    df = spark.createDataFrame([(1.0, [float("inf"), 2.0])], "a double, b array<double>").withColumn("c", F.lit(None).cast("double"))
    tables.write_results(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1.0,"b":[null,2.0],"c":null}'
    tables.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_table(df, str(tmp_path / "t"))
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.csv").write_text("1")
    one, two = (digests.directory_digest(spark, str(tmp_path / f), "*.csv").first() for f in ("x", "y"))
    assert one == two and one.rows == 1
    (tmp_path / "y" / "g.csv").write_text("1")
    assert digests.directory_digest(spark, str(tmp_path / "y"), "*.csv").first() != one


def test_hash_tree_names_the_bucket_of_a_changed_row(spark):
    rows = spark.range(2000).selectExpr("id", "concat('row ', id) AS text")
    changed = rows.withColumn("text", F.when(F.col("id") == 77, "other").otherwise(F.col("text")))
    tree, again, other = (digests.hash_tree(df, 2).cache() for df in (rows, rows.repartition(7).orderBy(F.desc("id")), changed))
    assert sorted(tree.collect()) == sorted(again.collect())
    assert digests.differing_buckets(tree, again).count() == 0
    hash_of = lambda df: digests.canonical_rows(df.filter("id = 77")).select(F.sha2("row_json", 256)).first()[0]
    found = {r.prefix: r.other_rows - r.rows for r in digests.differing_buckets(tree, other).collect()}
    was, now = hash_of(rows)[:2], hash_of(changed)[:2]
    assert was != now and found == {was: -1, now: 1}
    roots = [t.filter("prefix = ''").first() for t in (tree, other)]
    assert roots[0].rows == roots[1].rows == 2000 and roots[0].sha256 != roots[1].sha256


def test_hash_tree_counts_repeated_rows_and_has_no_root_without_rows(spark):
    one = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert digests.hash_tree(one, 1).filter("prefix = ''").first() != digests.hash_tree(one.distinct(), 1).filter("prefix = ''").first()
    assert digests.hash_tree(one.limit(0), 2).count() == 0


def test_places_of_rows_in_sorted_files(spark, tmp_path):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS v")
    rows.repartitionByRange(5, "v").sortWithinPartitions("v").write.parquet(str(tmp_path / "o"))
    got = files.read_in_order(spark, str(tmp_path / "o")).collect()
    assert sorted((r.v, r.place) for r in got) == [(i, i + 1) for i in range(5000)]
