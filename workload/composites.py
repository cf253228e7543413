"""Round trips through files, and composite runs with all their result tables in long form."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clean, features
from tidemark.plans import runs
from tidemark.plans.stage import register, shared_folder, stored
from tidemark.schemas import GRID
from tidemark.sinks import tables
from tidemark.sources import archives, files
from workload import sqltext as S
from workload.bindings import observations, rain_points, raw_records, table
from workload.queries import (
    ANCHORED_SQL,
    AS_OF,
    COMMON_SQL,
    FOCUS,
    FOCUS_SQL,
    RISK_SQL,
    SCORE_SQL,
    SQL,
    anchored,
    artifacts,
    filled,
    matrix,
    query,
    rain,
    user_thresholds,
)

# --- round trips ----------------------------------------------------------------------


def place(spark, name: str) -> str:
    return register(f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}")


@query("csv_round_trip", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events")
def csv_round_trip(spark, sf):
    path = place(spark, "events.csv")
    table(spark, sf, "events").select("event_id", "event_type", "props").write.option("header", True).csv(path)
    return files.read_raw(spark, path).select("event_id", "event_type", "props")


@query("parquet_round_trip", "SELECT CAST(event_id + 10000000 AS VARCHAR) AS z_id, CAST(event_type AS VARCHAR) AS event_type FROM events")
def parquet_round_trip(spark, sf):
    """Whole ids kept as doubles are read as plain digits."""
    path = place(spark, "events.parquet")
    rows = table(spark, sf, "events").select((F.col("event_id") + F.lit(10_000_000)).cast("double").alias("z_id"), "event_type")
    tables.write_table(rows, path)
    return files.read_raw(spark, path).select("z_id", "event_type")


#: A file of records holds 2 to this power at most, so that files grow in number with the rows alone.
STRETCH_BITS = 15


def json_arrays(events: DataFrame) -> DataFrame:
    """``stretch, value``: the records of a stretch of rows that stand together, as one JSON array."""
    record = F.struct(
        F.col("event_id").alias("z_id"), F.col("event_type").alias("time_d"), F.col("user_id").alias("station_code"), F.col("props").alias("note")
    )
    stretch = F.shiftright(F.monotonically_increasing_id(), STRETCH_BITS).alias("stretch")
    return events.groupBy(stretch).agg(F.to_json(F.collect_list(record)).alias("value"))


@query(
    "json_round_trip",
    "SELECT CAST(event_id AS VARCHAR) AS z_id, event_type AS time_d, CAST(user_id AS VARCHAR) AS station_code, props AS note, CAST(NULL AS VARCHAR) AS station_name FROM events",
)
def json_round_trip(spark, sf):
    """Events as files that hold a JSON array of a bounded stretch of rows; keys beyond the contract stay."""
    path = place(spark, "events.json")
    json_arrays(table(spark, sf, "events")).write.partitionBy("stretch").text(path)
    return files.read_raw(spark, path).select("z_id", "time_d", "station_code", "note", "station_name")


@query(
    "archive_round_trip",
    """SELECT CAST(event_id // 3000 AS VARCHAR) || '.zip' AS archive, CAST(event_id % 7 AS VARCHAR) || '.csv' AS member, count(*) AS rows,
  CAST(count(DISTINCT event_id // 2) AS BIGINT) AS unique_rows, CAST(sum(event_id) AS BIGINT) AS ids, max(event_type || '水位') AS level, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_time
FROM events GROUP BY event_id // 3000, event_id % 7""",
)
def archive_round_trip(spark, sf):
    """Shards in a Chinese encoding, packed into archives of at most 3000 rows, landed and read back member by member."""
    rows = table(spark, sf, "events").select(
        F.concat(F.floor(F.col("event_id") / 3000).cast("string"), F.lit(".zip")).alias("archive"),
        F.concat((F.col("event_id") % 7).cast("string"), F.lit(".csv")).alias("member"),
        F.col("event_id").alias("_pos"), F.col("event_id").cast("string").alias("z_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_d"), F.concat("event_type", F.lit("水位")).alias("up_water_level"),
    )
    landed = stored(archives.pack_shards(rows, "archive", "member"), "landed")
    back = archives.unpack_shards(landed)
    number = F.col("z_id").cast("long")
    return back.groupBy(F.col("_file").alias("archive"), F.col("_member").alias("member")).agg(
        F.count("*").alias("rows"), F.count_distinct(F.floor(number / 2)).alias("unique_rows"), F.sum(number).alias("ids"),
        F.max("up_water_level").alias("level"), F.max("time_d").alias("last_time"),
    )


GRID_SQL = f"WITH {S.grid(S.TYPE, 2)} SELECT series_key, tt AS observed_at, level AS water_level_m, imp AS is_imputed FROM grid"


def grid_columns(levels: DataFrame) -> DataFrame:
    return levels.select(*[part.split()[0] for part in GRID.split(", ")])


@query("contract_csv_round_trip", GRID_SQL)
def contract_csv_round_trip(spark, sf):
    path = place(spark, "grid.csv")
    tables.write_contract_csv(grid_columns(filled(spark, sf)), path)
    return files.read_levels(spark, path, GRID, "csv").select("series_key", "observed_at", "water_level_m", "is_imputed")


@query("grid_table_round_trip", GRID_SQL)
def grid_table_round_trip(spark, sf):
    path = place(spark, "grid.parquet")
    tables.write_table(grid_columns(filled(spark, sf)), path, partition_by=["series_key"])
    return files.read_levels(spark, path, GRID).select("series_key", "observed_at", "water_level_m", "is_imputed")


@query(
    "rain_files_round_trip",
    f"WITH {S.RAIN_POINTS} SELECT point_id, strftime(tt, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS observed_at, precipitation_mm, rain_mm FROM points",
)
def rain_files_round_trip(spark, sf):
    """One folder of files for each point, read together."""
    root = place(spark, "rain")
    stamp = F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    rows = rain_points(spark, sf).select(
        stamp.alias("observed_at"), "precipitation_mm", "rain_mm", "point_id",
        F.lit(120.0).alias("longitude"), F.lit(27.0).alias("latitude"), F.col("point_id").alias("folder"),
    )
    rows.repartition("folder").write.partitionBy("folder").option("header", True).csv(root)
    return files.read_rain_points(spark, root).select("point_id", "observed_at", "precipitation_mm", "rain_mm")


@query("snapshot_manifest", f"SELECT rows AS record_count, sha256 FROM ({SQL['dataset_digest']})")
def snapshot_manifest(spark, sf):
    at = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
    return tables.write_snapshot(
        table(spark, sf, "events"), place(spark, "snapshots"), dataset_id="events", source_name="table", acquired_at=at
    ).select("record_count", "sha256")


@query(
    "results_round_trip",
    """WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k > 0 THEN value / k END AS ratio FROM e""",
)
def results_round_trip(spark, sf):
    path = place(spark, "results")
    k = F.get_json_object("props", "$.k").cast("double")
    ratio = F.when(k != 0, F.col("value") / k).otherwise(F.lit(float("nan")))
    tables.write_results(table(spark, sf, "events").select("event_id", ratio.alias("ratio")), path)
    return spark.read.schema("event_id long, ratio double").json(path)


@query("header_mapping", "SELECT CAST(event_id AS VARCHAR) AS z_id, event_type AS time_d, props AS up_water_level FROM events")
def header_mapping(spark, sf):
    named = {"event_id": ' "主键" ', "event_type": "监测时间", "props": "实时水位"}
    rows = table(spark, sf, "events").select(
        *[F.col(c).cast("string").alias(n) for c, n in named.items()], F.col("user_id").alias("备注")
    )
    return clean.map_headers(rows, {"主键": "z_id", "监测时间": "time_d", "实时水位": "up_water_level"})


@query(
    "one_series",
    "SELECT CAST(event_id AS VARCHAR) AS source_record_id, ts AS observed_at, value AS water_level_m, CAST(row_number() OVER (ORDER BY ts, CAST(event_id AS VARCHAR)) AS BIGINT) AS place FROM events WHERE event_type = 'purchase'",
)
def one_series(spark, sf):
    """One station's rows in their stored order."""
    ordered = clean.sorted_observations(clean.select_series(observations(spark, sf), "purchase"))
    # The order of a stored table is restored from where its rows stand.
    path = place(spark, "ordered.parquet")
    ordered.select("source_record_id", "observed_at", "water_level_m").write.parquet(path)
    return files.read_in_order(spark, path)


@query(
    "prediction_files_round_trip",
    f"""WITH {S.features(S.TYPE, 2)}, a AS ({ANCHORED_SQL})
SELECT model || '_E1' AS model, CAST(horizon AS BIGINT) AS horizon, segment, anchor, target, observed, prediction FROM a""",
)
def prediction_files_round_trip(spark, sf):
    """A file for each horizon and segment, as models store them; the listing is checked before they are read."""
    told = stored(anchored(matrix(spark, sf)), "told")
    folder = place(spark, "predictions")
    for h in (1, 3, 6):
        for segment in ("train", "validation", "test"):
            rows = told.where((F.col("horizon") == h) & (F.col("segment") == segment))
            stamp = F.date_format("anchor", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("observed_at")
            rows.select(stamp, "segment", "observed", "prediction").write.option("header", True).csv(f"{folder}/E1/anchor_h{h}_{segment}.csv")
    back = files.read_predictions(spark, folder, experiments=["E1"], models=["anchor"])
    return back.select("model", "horizon", "segment", "anchor", "target", "observed", "prediction")


NUMBERS = ("water_level_t", "water_level_lag_24", "rain_lag_0", "rain_cum_24", "target_h1")


@query("feature_file_round_trip", f"WITH {S.features(S.TYPE, 2)} SELECT series_key, observed_at, {', '.join(NUMBERS)}, is_imputed_t FROM features")
def feature_file_round_trip(spark, sf):
    """Every number of a feature file must parse; missing ones stay missing."""
    path = place(spark, "features.csv")
    tables.write_contract_csv(matrix(spark, sf).select("series_key", "observed_at", *NUMBERS, "is_imputed_t"), path)
    schema = "series_key string, observed_at timestamp, " + ", ".join(f"{n} double" for n in NUMBERS) + ", is_imputed_t boolean"
    return files.read_levels(spark, path, schema, "csv")


# --- composite runs -------------------------------------------------------------------


#: Times among the id columns whose names do not say so.
STAMPS = ("target", "event_start")


def long_form(frames: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """``table_name, cell, metric, value`` of several tables, given as frame, id columns and metrics."""
    out = None
    for name, (df, ids, metrics) in frames.items():
        cell = F.concat_ws("|", *[F.coalesce(_text(df, c), F.lit("")) for c in ids])
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        part = df.select(F.lit(name).alias("table_name"), cell.alias("cell"), F.inline(pairs))
        out = part if out is None else out.unionByName(part)
    return out


def _text(df: DataFrame, name: str):
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return F.col(name).cast("string")


def long_sql(tables: dict[str, tuple[str, list[str], list[str]]]) -> str:
    parts = []
    for name, (sql, ids, metrics) in tables.items():
        cell = " || '|' || ".join(
            f"COALESCE({f'strftime({c}, ' + repr('%Y-%m-%d %H:%M:%S') + ')' if c.endswith('_at') or c in STAMPS else f'CAST({c} AS VARCHAR)'}, '')" for c in ids
        ) or "''"
        names = ", ".join(f"'{m}'" for m in metrics)
        values = ", ".join(f"CAST({m} AS DOUBLE)" for m in metrics)
        parts.append(
            f"SELECT '{name}' AS table_name, {cell} AS cell, unnest([{names}]) AS metric, round(unnest([{values}]) + 1e-9, 6) + 0.0 AS value FROM ({sql}) AS t{len(parts)}"
        )
    return " UNION ALL ".join(parts)


CELL = ["series_key", "model", "horizon", "segment"]
SCORES = ["sample_count", "mae", "rmse", "r2", "nse", "peak_absolute_error"]
PAIRS = ["paired_rows", "paired_observed_rows"]

def tables_of(result: dict[str, DataFrame], wanted: dict[str, tuple[str, list[str], list[str]]]) -> DataFrame:
    """The long form of every table of a run; a run must not return others."""
    if set(result) != set(wanted):
        raise ValueError(f"tables differ: {sorted(set(result) ^ set(wanted))}")
    return long_form({n: (result[n], ids, metrics) for n, (_, ids, metrics) in wanted.items()})


CONSTANT_CTE = f"""{S.persistence(S.USER, 2)}, m AS (SELECT series_key, avg(level) AS c FROM split WHERE segment = 'train' AND NOT imp AND level IS NOT NULL GROUP BY 1),
both_fc AS (SELECT * FROM fc UNION ALL BY NAME SELECT fc.* REPLACE ('train_mean' AS model, CASE WHEN prediction IS NOT NULL THEN c END AS prediction)
  FROM fc LEFT JOIN m ON fc.series_key = m.series_key)"""

HOURLY = {
    "metrics": (f"({SQL['persistence_metrics']}) UNION ALL BY NAME ({SQL['train_mean_metrics']})", CELL, [*SCORES, "excluded_imputed"]),
    "train_means": (
        f"WITH {S.split(S.USER, 2)} SELECT series_key, avg(level) AS train_mean FROM split WHERE segment = 'train' AND NOT imp AND level IS NOT NULL GROUP BY 1",
        ["series_key"], ["train_mean"],
    ),
    "forecasts": (f"WITH {CONSTANT_CTE} SELECT * FROM both_fc", [*CELL, "target"], ["prediction"]),
    "paired": (
        f"""WITH {CONSTANT_CTE} SELECT series_key, model, horizon, count(*) FILTER (observed IS NOT NULL AND prediction IS NOT NULL) AS paired_rows,
  count(*) FILTER (observed IS NOT NULL AND prediction IS NOT NULL AND NOT imp) AS paired_observed_rows FROM both_fc GROUP BY 1, 2, 3""",
        ["series_key", "model", "horizon"], PAIRS,
    ),
}


@query("hourly_baseline_run", long_sql(HOURLY))
def hourly_baseline_run(spark, sf):
    return tables_of(runs.hourly_baseline(filled(spark, sf, "user_id")), HOURLY)


FEATURES = {
    "rain": (SQL["areal_mean"], ["observed_at"], ["rainfall_mm", "point_count"]),
    "features": (SQL["station_feature_matrix"], ["series_key", "segment", "observed_at"],
                 ["water_level_t", "water_level_lag_6", "rain_lag_2", "rain_cum_12", "target_h3", "usable_h6"]),
    "ladder": (SQL["usability_ladder"], ["series_key", "horizon"],
               ["finite_pairs", "after_imputed_targets", "delivered", "targets_lost_to_imputation"]),
    "imputed_rows": (SQL["imputed_rows"], ["series_key", "observed_at"], ["water_level_m"]),
    "usable": (SQL["usable_per_segment"], ["series_key", "segment"], ["rows", "fit_rows", "usable_h1", "usable_h3", "usable_h6"]),
    "alignment": (SQL["rain_alignment"], ["series_key", "rain_point_count"], ["hours"]),
    "volume": (SQL["rain_volume"], [], ["points", "rows", "raw_diff_rows"]),
    "mean_differences": (SQL["mean_differences"], [], ["hours", "mean_diff_rows"]),
}


@query("feature_build_run", long_sql(FEATURES))
def feature_build_run(spark, sf):
    return tables_of(runs.feature_build(stored(filled(spark, sf, "user_id"), "grid"), rain_points(spark, sf)), FEATURES)


CLEANED = f"{S.RAW},\nobs AS (SELECT series_key, id, tt, num AS level FROM kept)"


def on_raw(sql: str, key: str = S.USER) -> str:
    """The SQL of a query over observations, over the cleaned raw records instead."""
    out = sql.replace(S.obs(key), CLEANED)
    for cast, name in (("ts AS tt", "tt"), ("CAST(ts AS DATE) AS day", "CAST(tt AS DATE) AS day")):
        bare = f"SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_key, {cast} FROM events"
        out = out.replace(bare, f"WITH {CLEANED} SELECT DISTINCT series_key, {name} FROM obs")
    return out.replace("arg_max(level, tt)", "arg_max(level, (tt, id))").replace("arg_max(id, tt)", "arg_max(id, (tt, id))")


LEVELS = ["water_level_m", "is_imputed"]
COUNTS = ["total_rows", "valid_rows", "duplicate_rows", "invalid_timestamp_rows", "invalid_level_rows", "missing_level_rows", "date_only_rows"]

BUILD = {
    "grid": (on_raw(GRID_SQL, S.TYPE), ["series_key", "observed_at"], LEVELS),
    "sweep": (on_raw(SQL["interpolation_sweep"]), ["series_key", "max_steps"], ["imputed_rows"]),
    "gap_statistics": (on_raw(SQL["gap_statistics"]), ["series_key"],
                       ["expected_buckets", "observed_buckets", "missing_buckets", "missing_rate", "duplicate_timestamps", "non_finite_values",
                        "total_missing_steps", "gap_segments", "gap_p50", "gap_p90", "gap_p99", "longest_gap"]),
    "top_gaps": (on_raw(SQL["gap_runs_topk"]), ["series_key", "gap_rank"], ["run_length"]),
    "sampling_interval": (on_raw(SQL["sampling_interval"]), ["series_key"], ["mode_seconds", "median_seconds", "min_seconds", "max_seconds", "interval_minutes"]),
    "day_coverage": (on_raw(SQL["day_coverage"]), ["series_key", "span_start", "span_end"], ["days_with_records", "longest_day_step", "missing_days"]),
    "missing_days": (f"SELECT *, 1 AS missing FROM ({on_raw(SQL['missing_days'])})", ["series_key", "day"], ["missing"]),
    "usable_samples": (on_raw(SQL["usable_samples"]), ["series_key"], ["usable_h1", "usable_h3", "usable_h6"]),
    "segments": (on_raw(SQL["chronological_segments"]), ["series_key", "segment"], ["hours", "missing_buckets", "imputed_rows", "usable_h1", "missing_rate"]),
    "summary": (SQL["quality_audit"], ["series_key"], COUNTS),
}


@query("grid_build_run", long_sql(BUILD))
def grid_build_run(spark, sf):
    result = runs.grid_build(raw_records(spark, sf), F.col("row_position"), max_steps=2)
    result["missing_days"] = result["missing_days"].withColumn("missing", F.lit(1))
    return tables_of(result, BUILD)


AUDIT_CTE = on_raw(S.persistence(S.TYPE, 2), S.TYPE)

AUDIT = {
    "summary": (SQL["quality_audit"], ["series_key"], [*COUNTS, "inferred_interval_minutes"]),
    "observations": (SQL["normalised_observations"], ["series_key", "source_record_id", "observed_at"], ["water_level_m"]),
    "grid": (on_raw(GRID_SQL, S.TYPE), ["series_key", "observed_at"], LEVELS),
    "forecasts": (f"WITH {AUDIT_CTE} SELECT * FROM fc", [*CELL, "target"], ["observed", "prediction"]),
    "metrics": (f"WITH {AUDIT_CTE} {SCORE_SQL.format(source='(SELECT * REPLACE (FALSE AS imp) FROM fc)')}", CELL, [*SCORES, "excluded_imputed"]),
    "segments": (on_raw(SQL["segment_counters"]), ["series_key", "segment"], ["rows", "imputed_rows", "missing_rows", "evaluated_rows", "imputed_ratio"]),
    "longest_run": (on_raw(SQL["longest_run"]), ["series_key"], ["rows", "longest_run"]),
}


@query("baseline_audit", long_sql(AUDIT))
def baseline_audit(spark, sf):
    return tables_of(runs.baseline_audit(raw_records(spark, sf), F.col("row_position")), AUDIT)


def per_model(sql: str) -> str:
    """The SQL of a query over persistence, over persistence and the anchor's level, one after the other.

    Both are scored on the rows of the same features.
    """
    persistence = S.persistence(S.TYPE, 2).removeprefix(f"{S.split(S.TYPE, 2)},\n")
    anchor = f"scored AS (SELECT *, FALSE AS imp FROM ({ANCHORED_SQL})), fc AS (SELECT * FROM scored)"
    given = [S.persistence(key, fill) for key in (S.USER, S.TYPE) for fill in (1, 2)]
    parts = []
    for made in (persistence, anchor):
        part = sql
        for old in given:
            part = part.replace(old, f"{S.features(S.TYPE, 2)},\n{made}")
        parts.append(f"({part})")
    return " UNION ALL ".join(parts)


def on_types(sql: str) -> str:
    """The SQL of a query, by event type and with gaps of two hours filled."""
    for old in (S.features(S.USER, 2), S.features(S.TYPE, 1)):
        sql = sql.replace(old, S.features(S.TYPE, 2))
    return sql.replace(S.split(S.TYPE, 1), S.split(S.TYPE, 2)).replace(S.split(S.USER, 2), S.split(S.TYPE, 2))


def at_80(sql: str) -> str:
    return sql.replace(S.thresholds(0.9), S.thresholds(0.8))


EVENT_COUNTS = ["tp", "fp", "fn", "observed_event_points", "observed_event_segments", "predicted_event_points", "predicted_event_segments", "precision", "recall", "f1"]
SUMMARY = ["threshold", "hours", "usable_observations", "max_level", "event_points", "event_segments"]

ANALYSIS = {
    "threshold": (on_types(SQL["high_level_thresholds"]), ["series_key"], ["threshold", "fit_rows"]),
    "threshold_sensitivity": (SQL["threshold_sensitivity"], ["series_key"], ["threshold", "fit_rows"]),
    "metrics": (per_model(f"WITH {S.persistence(S.TYPE, 2)} {SCORE_SQL.format(source='scored')}"), CELL, SCORES),
    "event_summary": (on_types(SQL["event_summary"]), ["series_key", "segment"], SUMMARY),
    "event_summary_sensitivity": (at_80(on_types(SQL["event_summary"])), ["series_key", "segment"], SUMMARY),
    "event_metrics": (per_model(SQL["event_metrics"]), CELL, EVENT_COUNTS),
    "event_metrics_sensitivity": (at_80(per_model(SQL["event_metrics"])), CELL, EVENT_COUNTS),
    "event_errors": (per_model(SQL["event_errors"]), [*CELL, "event_start"],
                     ["event_points", "sample_count", "mae", "observed_peak", "peak_prediction", "peak_underestimation"]),
    "peaks": (per_model(SQL["peak_diagnostics"]), CELL,
              ["sample_count", "observed_peak", "prediction_at_peak", "underestimation", "max_absolute_error", "peak_lag_hours"]),
    "leads": (per_model(SQL["warning_lead"]), [*CELL, "event_start"], ["event_points", "lead_hours", "first_prediction"]),
    "focus_rows": (per_model(SQL["residual_rows"]), ["series_key", "model", "horizon", "target"], ["absolute_error", "signed_error"]),
    "phases": (per_model(SQL["phase_error"]), ["series_key", "model", "horizon", "phase"], ["sample_count", "mae", "mean_signed_error"]),
    "largest_change": (
        f"""WITH {S.persistence(S.TYPE, 2)}, w AS (SELECT series_key, target, observed - lag(observed) OVER (PARTITION BY series_key ORDER BY target) AS d
  FROM scored WHERE horizon = 1 AND segment = 'test' AND target {FOCUS_SQL}),
b AS (SELECT series_key, d FROM w WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY abs(d) DESC, target) = 1)
SELECT k.series_key, d AS value FROM (SELECT DISTINCT series_key FROM w) k LEFT JOIN b USING (series_key)""",
        ["series_key"], ["value"],
    ),
    "common_support": (COMMON_SQL, CELL, ["sample_count", "mae", "rmse", "nse"]),
    "imputation": (on_types(SQL["imputation_profile"]), CELL,
                   ["usable_rows", "unmatched_rows", "rows_with_missing_features", "missing_feature_cells", "input_cells", "missing_cell_share"]),
    "usable": (on_types(SQL["usable_per_segment"]), ["series_key", "segment"], ["rows", "fit_rows", "usable_h1", "usable_h3", "usable_h6"]),
}


@query("error_analysis", long_sql(ANALYSIS))
def error_analysis(spark, sf):
    levels = stored(filled(spark, sf), "grid")
    m = stored(features.feature_matrix(levels, rain(spark, sf)), "features")
    return tables_of(runs.error_analysis(levels, m, anchored(m), ["anchor"], FOCUS), ANALYSIS)


@query("serving_run", f"SELECT series_key, observed_at, p1, p3, p6, model, level FROM ({RISK_SQL}) AS bundle")
def serving_run(spark, sf):
    """Every station at one moment, from observations and stored artifacts to risk."""
    bundle = runs.serving_bundle(
        observations(spark, sf, "user_id"), artifacts(spark, sf), user_thresholds(spark, sf), AS_OF, model="ridge"
    )
    ahead = [F.try_element_at("predictions", F.lit(h)).alias(f"p{h}") for h in (1, 3, 6)]
    return bundle.select("series_key", "observed_at", *ahead, "model", "level")
