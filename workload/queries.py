"""Registered queries: each one binds an operator to the test tables, next to its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers, text, timeline
from tidemark.plans.stage import stored
from tidemark.operators import clean, events, features, forecast, grid, metrics, models, quality, rainfall, risk
from tidemark.schemas import ARCHIVE_RESPONSE
from tidemark.sinks import digests
from tidemark.sources import responses
from workload import sqltext as S
from workload.bindings import daily_observations, observations, prop, rain_points, raw_records, shaped, table
from workload.result_types import DOUBLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

UTC = dt.timezone.utc
FOCUS = (dt.datetime(2024, 1, 26, tzinfo=UTC), dt.datetime(2024, 1, 29, 12, tzinfo=UTC))
FOCUS_SQL = "BETWEEN TIMESTAMP '2024-01-26 00:00:00' AND TIMESTAMP '2024-01-29 12:00:00'"
AS_OF = dt.datetime(2024, 1, 20, 6, tzinfo=UTC)
AS_OF_SQL = "TIMESTAMP '2024-01-20 06:00:00'"


def printed_alike(name: str, sql: str) -> str:
    """The SQL with doubles rounded like ``shaped`` does."""
    changes = [f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in DOUBLES.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql}) AS result" if changes else sql


def query(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf: shaped(build(spark, sf))
        if sql is not None:
            SQL[name] = printed_alike(name, sql)
        return build

    return add


# --- shared inputs -------------------------------------------------------------------


def filled(spark, sf, key="event_type", steps=2) -> DataFrame:
    return grid.resample(observations(spark, sf, key), "1h", max_steps=steps)


def split(spark, sf, key="event_type", steps=2) -> DataFrame:
    return grid.chronological_split(filled(spark, sf, key, steps))


def both_inputs(spark, sf, key="event_type", steps=2) -> tuple[DataFrame, DataFrame]:
    """Feature matrix and scored persistence of one grid.

    The grid is stored once: the matrix, its thresholds and the forecasts all read it.
    """
    levels = stored(filled(spark, sf, key, steps), "grid")
    m = stored(features.feature_matrix(levels, rain(spark, sf)), "features")
    return m, forecast.scored_rows(forecast.persistence_forecasts(grid.chronological_split(levels)))


def labelled_levels(parts: DataFrame) -> DataFrame:
    """Levels and segments of a split, named as in the matrix; thresholds and windows need no more."""
    return parts.withColumnsRenamed({"water_level_m": "water_level_t", "is_imputed": "is_imputed_t"})


def split_and_scored(spark, sf, key="event_type", steps=2) -> tuple[DataFrame, DataFrame]:
    """Levels of the split and scored persistence of one grid, which is stored once."""
    levels = grid.chronological_split(stored(filled(spark, sf, key, steps), "grid"))
    return labelled_levels(levels), forecast.scored_rows(forecast.persistence_forecasts(levels))


def rain(spark, sf) -> DataFrame:
    return rainfall.areal_mean(rain_points(spark, sf))


def matrix(spark, sf, key="event_type", steps=2, positions=False) -> DataFrame:
    return features.features_from_observations(
        observations(spark, sf, key), rain(spark, sf), "1h", max_steps=steps, positions=positions
    )


def scored(spark, sf, key="event_type", steps=2) -> DataFrame:
    return forecast.scored_rows(forecast.persistence_forecasts(split(spark, sf, key, steps)))


def anchored(m: DataFrame) -> DataFrame:
    """The in-segment sample set as a second forecast: the anchor level for every usable row."""
    lines = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"usable_h{h}").alias("u"), F.col(f"target_h{h}").alias("observed"))
            for h in (1, 3, 6)
        ]
    )
    long = m.select("series_key", "segment", "observed_at", "water_level_t", F.inline(lines)).filter("u")
    return long.select(
        "series_key", F.lit("anchor").alias("model"), "horizon", "segment",
        F.col("observed_at").alias("anchor"),
        timeline.shift_steps(F.col("observed_at"), F.col("horizon"), timeline.HOUR_US).alias("target"),
        "observed", F.col("water_level_t").alias("prediction"),
    )


ANCHORED_SQL = " UNION ALL ".join(
    f"SELECT series_key, 'anchor' AS model, {h} AS horizon, segment, observed_at AS anchor, "
    f"observed_at + INTERVAL {h} HOUR AS target, target_h{h} AS observed, water_level_t AS prediction "
    f"FROM features WHERE usable_h{h}"
    for h in (1, 3, 6)
)

# --- grid ----------------------------------------------------------------------------


@query(
    "hourly_last_value",
    f"WITH {S.obs()} SELECT series_key, date_trunc('hour', tt) AS observed_at, "
    "arg_max(level, tt) AS water_level_m, arg_max(id, tt) AS source_record_id FROM obs GROUP BY 1, 2",
)
def hourly_last_value(spark, sf):
    return grid.bucket_last(observations(spark, sf), "1h").select(
        "series_key", "observed_at", "water_level_m", "source_record_id"
    )


GRID_COLUMNS = ("series_key", "observed_at", "water_level_m", "is_imputed", "quality_flag",
                "source_record_id", "grid_pos", "grid_len")
GRID_SQL = ("SELECT series_key, tt AS observed_at, level AS water_level_m, imp AS is_imputed, "
            "CASE WHEN imp THEN 'imputed' WHEN raw IS NOT NULL THEN 'normal' END AS quality_flag, "
            "id AS source_record_id, pos AS grid_pos, n AS grid_len FROM grid")


@query("hourly_grid_gapfill", f"WITH {S.grid(S.TYPE, 1)} {GRID_SQL}")
def hourly_grid_gapfill(spark, sf):
    return filled(spark, sf, "event_type", 1).select(*GRID_COLUMNS)


@query("station_grid_gapfill", f"WITH {S.grid(S.USER, 3)} {GRID_SQL}")
def station_grid_gapfill(spark, sf):
    return filled(spark, sf, "user_id", 3).select(*GRID_COLUMNS)


@query(
    "daily_grid",
    """WITH b AS (SELECT o_orderpriority AS series_key, o_orderdate AS tt,
  arg_max(o_totalprice, o_orderkey) AS level FROM orders GROUP BY 1, 2),
s AS (SELECT series_key, min(tt) AS a, max(tt) AS z FROM b GROUP BY 1),
d AS (SELECT series_key, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS tt FROM s),
g AS (SELECT d.series_key, d.tt, b.level, lag(b.level) OVER w AS l, lead(b.level) OVER w AS r
  FROM d LEFT JOIN b ON d.series_key = b.series_key AND d.tt = b.tt
  WINDOW w AS (PARTITION BY d.series_key ORDER BY d.tt))
SELECT series_key, tt AS observed_at, COALESCE(level, (l + r) / 2) AS water_level_m,
  level IS NULL AND l IS NOT NULL AND r IS NOT NULL AS is_imputed FROM g""",
)
def daily_grid(spark, sf):
    return grid.resample(daily_observations(spark, sf), "1d", max_steps=1).select(
        "series_key", "observed_at", "water_level_m", "is_imputed"
    )


SWEEP_SQL = " UNION ALL ".join(
    f"""SELECT series_key, CAST({n} AS BIGINT) AS max_steps, count(*) AS rows,
  count(*) FILTER (gap <= {n}) AS imputed_rows,
  round(count(*) FILTER (gap <= {n}) / CAST(count(*) AS DOUBLE), 6) AS imputed_rate,
  count(*) FILTER (NOT has_{n}) AS remaining_missing,
  {", ".join(f"count(*) FILTER (has_{n} AND a_{n}_{h}) AS usable_h{h}" for h in (1, 3, 6))}
  FROM ahead GROUP BY 1"""
    for n in (0, 1, 2, 3, 6)
)


@query(
    "interpolation_sweep",
    f"""WITH {S.grid(S.USER, 0)},
has AS (SELECT *, {", ".join(f"raw IS NOT NULL OR COALESCE(gap <= {n}, FALSE) AS has_{n}" for n in (0, 1, 2, 3, 6))} FROM grid),
ahead AS (SELECT *, {", ".join(f"lead(has_{n}, {h}) OVER w AS a_{n}_{h}" for n in (0, 1, 2, 3, 6) for h in (1, 3, 6))}
  FROM has WINDOW w AS (PARTITION BY series_key ORDER BY pos))
{SWEEP_SQL}""",
)
def interpolation_sweep(spark, sf):
    return grid.interpolation_sweep(grid.complete_grid(observations(spark, sf, "user_id"), "1h"))


COVER_COLUMNS = ("series_key", "segment", "start_at", "end_at", "hours", "missing_buckets", "imputed_rows",
                 "usable_h1", "usable_h3", "usable_h6", "missing_rate")


@query(
    "chronological_segments",
    f"""WITH {S.split(S.USER, 2)},
ahead AS (SELECT *, {", ".join(f"lead(level, {h}) OVER w AS h{h}" for h in (1, 3, 6))}
  FROM split WINDOW w AS (PARTITION BY series_key, segment ORDER BY pos))
SELECT series_key, segment, min(tt) AS start_at, max(tt) AS end_at, count(*) AS hours,
  count(*) FILTER (level IS NULL) AS missing_buckets, count(*) FILTER (imp) AS imputed_rows,
  {", ".join(f"count(*) FILTER (level IS NOT NULL AND h{h} IS NOT NULL) AS usable_h{h}" for h in (1, 3, 6))},
  round(count(*) FILTER (level IS NULL) / CAST(count(*) AS DOUBLE), 6) AS missing_rate
FROM ahead GROUP BY 1, 2""",
)
def chronological_segments(spark, sf):
    return quality.segment_coverage(split(spark, sf, "user_id")).select(*COVER_COLUMNS)


@query(
    "segment_counters",
    f"""WITH {S.split(S.USER, 2)}
SELECT series_key, segment, count(*) AS rows, count(*) FILTER (imp) AS imputed_rows,
  count(*) FILTER (level IS NULL) AS missing_rows,
  count(*) FILTER (level IS NOT NULL AND NOT imp) AS evaluated_rows,
  round(count(*) FILTER (imp) / CAST(count(*) AS DOUBLE), 6) AS imputed_ratio FROM split GROUP BY 1, 2""",
)
def segment_counters(spark, sf):
    return quality.segment_counters(split(spark, sf, "user_id"))


# --- cleaning and audit --------------------------------------------------------------


@query(
    "normalised_observations",
    f"WITH {S.RAW} SELECT series_key, id AS source_record_id, tt AS observed_at, num AS water_level_m FROM kept",
)
def normalised_observations(spark, sf):
    return clean.normalise(raw_records(spark, sf), F.col("row_position")).select(
        "series_key", "source_record_id", "observed_at", "water_level_m"
    )


@query(
    "quality_audit",
    f"""WITH {S.RAW},
tally AS (SELECT series_key, count(*) AS total_rows,
  count(*) FILTER (reason = 'invalid_timestamp') AS invalid_timestamp_rows,
  count(*) FILTER (reason = 'invalid_level') AS invalid_level_rows,
  count(*) FILTER (reason = 'missing_level') AS missing_level_rows,
  count(*) FILTER (length(time_d) = 10) AS date_only_rows FROM judged GROUP BY 1),
good AS (SELECT series_key, count(*) AS valid_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
  min(tt) AS start_at, max(tt) AS end_at FROM kept GROUP BY 1),
stamps AS (SELECT DISTINCT series_key, tt FROM kept),
gaps AS (SELECT series_key, epoch_us(tt) - epoch_us(lag(tt) OVER (PARTITION BY series_key ORDER BY tt)) AS g FROM stamps),
med AS (SELECT series_key, median(g / 60000000.0) AS m FROM gaps WHERE g IS NOT NULL GROUP BY 1)
SELECT t.series_key, total_rows, valid_rows, duplicate_rows, invalid_timestamp_rows, invalid_level_rows,
  missing_level_rows, date_only_rows, start_at, end_at,
  total_rows = valid_rows + duplicate_rows + invalid_timestamp_rows + invalid_level_rows + missing_level_rows AS conserved,
  m AS inferred_interval_minutes
FROM tally t JOIN good USING (series_key) LEFT JOIN med USING (series_key)""",
)
def quality_audit(spark, sf):
    audit = stored(clean.audit_ids(raw_records(spark, sf), F.col("row_position")), "audit")
    return quality.quality_summary(clean.audited_counts(audit), clean.audited_observations(audit))


@query(
    "dedup_last_any",
    f"""WITH {S.RAW}, w AS (SELECT series_key, id, arg_max(pos, pos) AS pos FROM typed WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT t.series_key, z_id, time_d, up_water_level, t.pos AS row_position FROM typed t JOIN w ON w.pos = t.pos
UNION ALL SELECT series_key, z_id, time_d, up_water_level, pos FROM typed WHERE id IS NULL""",
)
def dedup_last_any(spark, sf):
    return clean.last_occurrence(raw_records(spark, sf), F.col("row_position"), ["series_key"])


@query(
    "archive_inspection",
    f"""WITH {S.RAW}, per AS (SELECT id, count(*) AS n FROM typed GROUP BY 1),
u AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(CASE WHEN id IS NULL THEN n ELSE 1 END) AS BIGINT) AS unique_rows FROM per)
SELECT series_key AS member, count(*) AS rows, CAST(NULL AS BIGINT) AS unique_rows, CAST(NULL AS BIGINT) AS duplicate_rows FROM typed GROUP BY 1
UNION ALL SELECT NULL, total_rows, unique_rows, total_rows - unique_rows FROM u""",
)
def archive_inspection(spark, sf):
    rows = raw_records(spark, sf).withColumnRenamed("series_key", "member")
    return clean.archive_counts(rows, "member")


@query(
    "sample_rows",
    f"""WITH {S.RAW} SELECT series_key, tt AS observed_at, arg_max(num, pos) AS water_level_m FROM typed
WHERE tt IS NOT NULL AND num IS NOT NULL AND isfinite(num) GROUP BY 1, 2""",
)
def sample_rows(spark, sf):
    return clean.latest_per_stamp(raw_records(spark, sf), F.col("row_position"))


@query(
    "sample_notes",
    f"""WITH {S.RAW}, per AS (SELECT series_key, tt, count(*) AS n,
  count(*) FILTER (tt IS NOT NULL AND num IS NOT NULL AND isfinite(num)) AS ok FROM typed GROUP BY 1, 2)
SELECT series_key, CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (ok > 0) AS usable_rows,
  CAST(COALESCE(sum(n) FILTER (tt IS NULL), 0) AS BIGINT) AS invalid_timestamp_rows,
  CAST(COALESCE(sum(n - ok) FILTER (tt IS NOT NULL), 0) AS BIGINT) AS unusable_level_rows,
  CAST(sum(greatest(ok - 1, 0)) AS BIGINT) AS duplicate_stamp_rows FROM per GROUP BY 1""",
)
def sample_notes(spark, sf):
    return clean.sample_notes(raw_records(spark, sf))


@query(
    "scalar_coercion",
    """WITH e AS (SELECT event_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CAST(k AS VARCHAR) AS numeric_id,
  CASE WHEN k = 1 THEN TRUE WHEN k = 0 THEN FALSE END AS flag,
  upper(event_type) AS label, CAST(hour(ts) AS BIGINT) AS hour_of_day, CAST(month(ts) AS BIGINT) AS month,
  ts + k * INTERVAL 1 HOUR AS shifted, CASE WHEN k > 0 THEN value / k END AS ratio,
  CASE event_id % 9 WHEN 1 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('hour', ts) - INTERVAL 8 HOUR WHEN 6 THEN date_trunc('second', ts)
    WHEN 7 THEN ts WHEN 8 THEN NULL ELSE date_trunc('minute', ts) END AS spelt FROM e""",
)
def scalar_coercion(spark, sf):
    k = F.col("k")
    ts = F.col("ts").cast("timestamp")
    clock = timeline.clock_features(ts)
    forms = ("d MMM yyyy HH:mm", "dd-MMM-yyyy", "MMM d, yyyy h:mm a", "yyyy-MM-dd hh:mm a", "yyyy.MM.dd HH:mm", "yyyy-MM-dd'T'HH'+08'",
             "EEE, dd MMM yyyy HH:mm:ss '+0000'", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    spelt = F.lit("no time")
    for n, form in enumerate(forms):
        spelt = F.when(F.col("event_id") % 9 == n, F.date_format(ts, form)).otherwise(spelt)
    rows = table(spark, sf, "events").withColumns({"k": prop(), "stamp": spelt})
    return text.with_timestamp(rows, "stamp", "spelt").select(
        "event_id",
        "spelt",
        text.record_id(k.cast("double").cast("string"), numeric_source=True).alias("numeric_id"),
        text.boolean_text(F.concat(F.lit(" "), k.cast("string"), F.lit(".0"))).alias("flag"),
        text.optional_text(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).alias("label"),
        clock["hour_of_day"].alias("hour_of_day"),
        clock["month"].alias("month"),
        timeline.shift_steps(ts, k, timeline.HOUR_US).alias("shifted"),
        numbers.share(F.col("value"), k).alias("ratio"),
    )


@query(
    "zone_stamps",
    """WITH e AS (SELECT event_id, event_id % 300 AS m FROM events),
w AS (SELECT event_id, m, CASE event_id % 3 WHEN 0 THEN TIMESTAMP '2024-03-10' WHEN 1 THEN TIMESTAMP '2024-11-03' ELSE TIMESTAMP '2024-07-01' END + m * INTERVAL 1 MINUTE AS t FROM e)
SELECT event_id, CAST(CASE event_id % 3
  WHEN 0 THEN CASE WHEN m < 120 THEN epoch(t) + 18000 WHEN m >= 180 THEN epoch(t) + 14400 END
  WHEN 1 THEN CASE WHEN m < 60 THEN epoch(t) + 14400 WHEN m >= 120 THEN epoch(t) + 18000 END
  ELSE epoch(t) + 14400 END AS BIGINT) AS at_second FROM w""",
)
def zone_stamps(spark, sf):
    """Wall times of New York around both clock changes: what an hour skips or repeats is refused."""
    before = spark.conf.get("spark.sql.session.timeZone")
    day = F.when(F.col("event_id") % 3 == 0, "2024-03-10").when(F.col("event_id") % 3 == 1, "2024-11-03").otherwise("2024-07-01")
    minute = (F.col("event_id") % 300).cast("int")
    clock = F.format_string("%s %02d:%02d:00", day, F.floor(minute / 60).cast("int"), minute % 60)
    rows = table(spark, sf, "events").select("event_id", clock.alias("stamp"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # Stored while the zone holds: what is read from it does not depend on the session.
        return stored(text.with_timestamp(rows, "stamp", "at").select("event_id", F.unix_seconds("at").alias("at_second")), "stamps")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@query(
    "uniform_offset",
    """WITH e AS (SELECT event_type, '+0' || CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN '8' ELSE '1' END || ':00' AS o, ts FROM events)
SELECT event_type, count(*) AS rows, count(DISTINCT o) AS offsets, min(CASE WHEN o = '+08:00' THEN ts - INTERVAL 8 HOUR ELSE ts - INTERVAL 1 HOUR END) AS first_at
FROM e GROUP BY 1""",
)
def uniform_offset(spark, sf):
    # Wall time printed with the offset the row claims; milliseconds are kept.
    wall = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = F.when(prop() < 50, F.lit("+08:00")).otherwise(F.lit("+01:00"))
    rows = table(spark, sf, "events").select("event_type", F.concat(wall, offset).alias("stamp"))
    return quality.offset_summary(rows, "stamp", ["event_type"])


@query(
    "contract_checks",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type AS series_key, count(*) AS checked_rows, count(*) FILTER (k < 3) AS blank_id,
  count(*) FILTER (k = 7) AS missing_time, count(*) FILTER (value IS NULL OR k IN (20, 22, 23)) AS non_finite_level,
  count(*) FILTER (k IN (30, 31)) AS unknown_flag FROM e GROUP BY 1""",
)
def contract_checks(spark, sf):
    from tidemark.schemas import observation_rules

    k = F.col("k")
    flawed = table(spark, sf, "events").withColumn("k", prop()).select(
        F.col("event_type").alias("series_key"),
        F.when(k < 3, F.lit(" \t")).otherwise(F.col("event_id").cast("string")).alias("source_record_id"),
        F.when(k != 7, F.col("ts").cast("timestamp")).alias("observed_at"),
        F.when(k == 22, F.lit(float("nan"))).when(k == 23, F.lit(float("inf"))).when(k != 20, F.col("value")).alias("water_level_m"),
        F.when(k == 30, F.lit("odd")).when(k != 31, F.lit("normal")).alias("quality_flag"),
    )
    return quality.check_rows(flawed, observation_rules(), ["series_key"])


@query(
    "order_violations",
    """WITH o AS (SELECT o_orderpriority AS series_key, o_orderdate AS tt,
  lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before FROM orders)
SELECT series_key, count(*) - count(DISTINCT tt) AS duplicate_stamps, count(*) FILTER (tt <= before) AS order_violations
FROM o GROUP BY 1""",
)
def order_violations(spark, sf):
    return quality.order_violations(daily_observations(spark, sf))


@query(
    "history_range",
    f"SELECT CAST(user_id AS VARCHAR) AS series_key, ts AS observed_at, value AS water_level_m FROM events WHERE ts {FOCUS_SQL}",
)
def history_range(spark, sf):
    return clean.in_range(observations(spark, sf, "user_id"), *FOCUS).select(
        "series_key", "observed_at", "water_level_m"
    )


@query(
    "latest_points",
    """SELECT CAST(user_id AS VARCHAR) AS series_key, ts AS observed_at, value AS water_level_m FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 3""",
)
def latest_points(spark, sf):
    return forecast.latest_before(observations(spark, sf, "user_id"), n=3).select(
        "series_key", "observed_at", "water_level_m"
    )


# --- gaps, intervals, coverage ------------------------------------------------------


def gap_cte(key: str, fill: int) -> str:
    return f"WITH {S.grid(key, fill)}, flagged AS (SELECT *, level IS NULL AS f FROM grid), gaps AS ({S.runs('flagged', 'f', 'tt', 'series_key')})"


@query("gap_runs", f"{gap_cte(S.USER, 2)} SELECT series_key, run_start AS start_at, run_end AS end_at, run_length FROM gaps")
def gap_runs(spark, sf):
    return quality.missing_runs(filled(spark, sf, "user_id"))


@query(
    "gap_runs_topk",
    f"""{gap_cte(S.USER, 2)} SELECT * FROM (SELECT series_key, run_start AS start_at, run_end AS end_at, run_length,
  row_number() OVER (PARTITION BY series_key ORDER BY run_length DESC, run_start) AS gap_rank FROM gaps) WHERE gap_rank <= 10""",
)
def gap_runs_topk(spark, sf):
    return quality.top_gaps(quality.missing_runs(filled(spark, sf, "user_id")))


@query(
    "gap_statistics",
    f"""{gap_cte(S.USER, 2)},
cells AS (SELECT series_key, min(tt) AS first_at, max(tt) AS last_at, count(*) AS expected_buckets,
  count(level) AS observed_buckets, count(*) - count(DISTINCT tt) AS duplicate_timestamps,
  count(*) FILTER (level IS NULL OR NOT isfinite(level)) AS non_finite_values FROM grid GROUP BY 1),
stats AS (SELECT series_key, count(*) AS gap_segments, quantile_cont(run_length, 0.5) AS p50, quantile_cont(run_length, 0.9) AS p90,
  quantile_cont(run_length, 0.99) AS p99, max(run_length) AS longest, sum(run_length) AS total FROM gaps GROUP BY 1),
top AS (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY run_length DESC, run_start) = 1)
SELECT c.series_key, first_at, last_at, expected_buckets, observed_buckets, expected_buckets - observed_buckets AS missing_buckets,
  round((expected_buckets - observed_buckets) / CAST(expected_buckets AS DOUBLE), 6) AS missing_rate,
  COALESCE(gap_segments, 0) AS gap_segments, p50 AS gap_p50, p90 AS gap_p90, p99 AS gap_p99,
  COALESCE(longest, 0) AS longest_gap, t.run_start AS longest_gap_start, t.run_end AS longest_gap_end,
  duplicate_timestamps, non_finite_values, CAST(COALESCE(total, 0) AS BIGINT) AS total_missing_steps
FROM cells c LEFT JOIN stats s ON c.series_key = s.series_key LEFT JOIN top t ON c.series_key = t.series_key""",
)
def gap_statistics(spark, sf):
    return quality.gap_statistics(filled(spark, sf, "user_id"))


@query(
    "longest_run",
    f"""WITH {S.grid(S.USER, 2)}, flagged AS (SELECT *, level IS NULL OR imp AS f FROM grid),
r AS ({S.runs('flagged', 'f', 'tt', 'series_key')}), n AS (SELECT series_key, count(*) AS rows FROM grid GROUP BY 1)
SELECT n.series_key, rows, COALESCE((SELECT max(run_length) FROM r WHERE r.series_key = n.series_key), 0) AS longest_run FROM n""",
)
def longest_run(spark, sf):
    return quality.longest_run(filled(spark, sf, "user_id"))


@query(
    "sampling_interval",
    """WITH s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_key, ts AS tt FROM events),
g AS (SELECT series_key, epoch_us(tt) - epoch_us(lag(tt) OVER (PARTITION BY series_key ORDER BY tt)) AS d FROM s),
c AS (SELECT series_key, d, count(*) AS n FROM g WHERE d IS NOT NULL GROUP BY 1, 2),
m AS (SELECT series_key, d FROM c QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY n DESC, d) = 1),
a AS (SELECT series_key, median(d / 1e6) AS med, min(d / 1e6) AS lo, max(d / 1e6) AS hi FROM g WHERE d IS NOT NULL GROUP BY 1),
k AS (SELECT DISTINCT series_key FROM s)
SELECT k.series_key, m.d / 1e6 AS mode_seconds, med AS median_seconds, lo AS min_seconds, hi AS max_seconds,
  med / 60 AS interval_minutes FROM k LEFT JOIN m USING (series_key) LEFT JOIN a USING (series_key)""",
)
def sampling_interval(spark, sf):
    return quality.sampling_interval(observations(spark, sf, "user_id"))


@query(
    "day_coverage",
    """WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_key, CAST(ts AS DATE) AS day FROM events),
s AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY series_key ORDER BY day), day) AS step FROM d)
SELECT series_key, count(*) AS days_with_records, min(day) AS span_start, max(day) AS span_end,
  COALESCE(max(step), 0) AS longest_day_step, date_diff('day', min(day), max(day)) + 1 - count(*) AS missing_days
FROM s GROUP BY 1""",
)
def day_coverage(spark, sf):
    return quality.day_coverage(observations(spark, sf, "user_id"))


@query(
    "missing_days",
    """WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_key, CAST(ts AS DATE) AS day FROM events),
s AS (SELECT series_key, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
c AS (SELECT series_key, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT series_key, day FROM c EXCEPT SELECT series_key, day FROM d""",
)
def missing_days(spark, sf):
    return quality.missing_days(observations(spark, sf, "user_id"))


@query(
    "usable_samples",
    f"""WITH {S.grid(S.USER, 2)},
a AS (SELECT *, {", ".join(f"lead(level, {h}) OVER w AS h{h}" for h in (1, 3, 6))} FROM grid WINDOW w AS (PARTITION BY series_key ORDER BY pos))
SELECT series_key, {", ".join(f"count(*) FILTER (level IS NOT NULL AND h{h} IS NOT NULL) AS usable_h{h}" for h in (1, 3, 6))} FROM a GROUP BY 1""",
)
def usable_samples(spark, sf):
    return quality.usable_samples(filled(spark, sf, "user_id"))


def chunked(spark, sf):
    day = F.to_date("observed_at")
    return rain_points(spark, sf).withColumns(
        {"start_date": F.to_date(F.date_trunc("week", "observed_at")), "end_date": F.date_add(F.to_date(F.date_trunc("week", day)), 6)}
    )


CHUNK_CTE = f"""WITH {S.RAIN_POINTS},
ch AS (SELECT point_id, CAST(date_trunc('week', tt) AS DATE) AS start_date, CAST(date_trunc('week', tt) AS DATE) + 6 AS end_date,
  count(*) AS rows, count(DISTINCT tt) AS uniq, bool_and(minute(tt) = 0 AND second(tt) = 0) AS hour_aligned,
  count(*) FILTER (precipitation_mm <> rain_mm) AS diff_rows, max(abs(precipitation_mm - rain_mm)) AS max_abs_diff,
  min(tt) FILTER (precipitation_mm <> rain_mm) AS first_diff_at, min(tt) AS start_timestamp, max(tt) AS end_timestamp
  FROM points GROUP BY 1, 2, 3)"""


@query(
    "chunk_quality",
    f"""{CHUNK_CTE} SELECT point_id, start_date, end_date, rows, CAST(0 AS BIGINT) AS non_finite_precipitation, CAST(0 AS BIGINT) AS non_finite_rain,
  hour_aligned, 'Z' AS utc_offsets, diff_rows, max_abs_diff, first_diff_at, start_timestamp, end_timestamp, CAST(168 AS BIGINT) AS expected_hours,
  greatest(168 - uniq, 0) AS missing_hours, round(greatest(168 - uniq, 0) / 168.0, 6) AS missing_rate, rows - uniq AS duplicate_timestamps FROM ch""",
)
def chunk_quality(spark, sf):
    return quality.chunk_quality(chunked(spark, sf)).withColumn("utc_offsets", F.array_join("utc_offsets", ","))


@query(
    "chunk_rollup",
    f"""{CHUNK_CTE} SELECT point_id, count(*) AS chunks, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(168) AS BIGINT) AS expected_hours,
  CAST(sum(greatest(168 - uniq, 0)) AS BIGINT) AS missing_hours, CAST(sum(rows - uniq) AS BIGINT) AS duplicate_timestamps,
  CAST(sum(diff_rows) AS BIGINT) AS diff_rows, bool_and(hour_aligned) AS all_hour_aligned FROM ch GROUP BY ROLLUP (point_id)""",
)
def chunk_rollup(spark, sf):
    return quality.chunk_rollup(quality.chunk_quality(chunked(spark, sf)))


@query(
    "chunk_state",
    """WITH p AS (SELECT DISTINCT o_orderpriority AS point_id FROM orders),
y AS (SELECT point_id, unnest(generate_series(1994, 2002)) AS y FROM p),
plan AS (SELECT point_id, greatest(make_date(y, 1, 1), DATE '1994-06-01') AS start_date, least(make_date(y, 12, 31), DATE '2002-03-31') AS end_date FROM y),
l AS (SELECT o_orderpriority AS point_id, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2),
j AS (SELECT plan.*, n, (date_diff('day', start_date, end_date) + 1) * 24 AS e FROM plan LEFT JOIN l ON plan.point_id = l.point_id AND year(start_date) = l.y)
SELECT point_id, start_date, end_date, rows, receipt_rows, CAST(e AS BIGINT) AS expected_hours,
  CASE WHEN rows IS NULL THEN 'missing' WHEN rows <= 0 THEN 'empty' WHEN rows <> e THEN 'incomplete'
    WHEN receipt_rows <> rows THEN 'stale_receipt' ELSE 'complete' END AS state
FROM (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN point_id LIKE '1%' THEN e WHEN point_id LIKE '2%' THEN 0 ELSE n END AS rows,
  CASE WHEN n IS NULL OR year(start_date) = 1996 THEN NULL WHEN point_id LIKE '1%' AND year(start_date) % 2 = 1 THEN e ELSE n END AS receipt_rows FROM j) z""",
)
def chunk_state(spark, sf):
    orders = table(spark, sf, "orders")
    points = orders.select(F.col("o_orderpriority").alias("point_id")).distinct()
    planned = quality.year_chunks(points, dt.date(1994, 6, 1), dt.date(2002, 3, 31))
    year = F.year("o_orderdate")
    loaded = orders.groupBy(F.col("o_orderpriority").alias("point_id"), year.alias("y")).agg(F.count("*").alias("rows"))
    # One priority is loaded in full and one came empty; receipts of even years are older, one year has none.
    full, n = F.startswith("point_id", F.lit("1")), F.col("rows")
    hours = ((F.date_diff("end_date", "start_date") + 1) * 24).cast("long")
    receipt = F.when(F.col("y") != 1996, F.when(full & (F.col("y") % 2 == 1), hours).otherwise(n))
    dated = planned.withColumn("y", F.year("start_date")).join(loaded, ["point_id", "y"]).select(
        "point_id", "start_date", "end_date",
        F.when(full, hours).when(F.startswith("point_id", F.lit("2")), 0).otherwise(n).alias("rows"),
        receipt.alias("receipt_rows"),
    )
    return quality.chunk_state(planned, dated)


# --- rainfall ------------------------------------------------------------------------


@query("areal_mean", f"WITH {S.RAIN} SELECT tt AS observed_at, rain AS rainfall_mm, points AS point_count FROM rain")
def areal_mean(spark, sf):
    return rain(spark, sf)


@query(
    "rain_volume",
    f"""WITH {S.RAIN_POINTS} SELECT count(DISTINCT point_id) AS files, count(DISTINCT point_id) AS points, count(*) AS rows, min(tt) AS first_at,
  max(tt) AS last_at, count(*) FILTER (precipitation_mm <> rain_mm) AS raw_diff_rows FROM points""",
)
def rain_volume(spark, sf):
    return rainfall.source_volume(rain_points(spark, sf), F.col("point_id"))


@query(
    "mean_differences",
    f"""WITH {S.RAIN_POINTS}, h AS (SELECT tt, avg(precipitation_mm) AS p, avg(rain_mm) AS r FROM points GROUP BY 1)
SELECT count(*) AS hours, count(*) FILTER (p <> r) AS mean_diff_rows FROM h""",
)
def mean_differences(spark, sf):
    return rainfall.mean_differences(rain_points(spark, sf))


@query(
    "measure_gaps",
    f"""WITH {S.RAIN_POINTS} SELECT point_id, count(*) FILTER (precipitation_mm <> rain_mm) AS diff_rows,
  min(tt) FILTER (precipitation_mm <> rain_mm) AS first_diff_at, max(abs(precipitation_mm - rain_mm)) AS max_abs_diff FROM points GROUP BY 1""",
)
def measure_gaps(spark, sf):
    return rainfall.measure_gaps(rain_points(spark, sf))


@query(
    "point_selection",
    f"""WITH {S.RAIN_POINTS}, w AS (SELECT point_id FROM points GROUP BY 1 HAVING max(rain_mm) > 0)
SELECT p.point_id, count(*) AS rows FROM points p WHERE p.point_id IN (SELECT point_id FROM w) GROUP BY 1""",
)
def point_selection(spark, sf):
    points = rain_points(spark, sf)
    wanted = points.groupBy("point_id").agg(F.max("rain_mm").alias("m")).filter("m > 0")
    return rainfall.select_points(points, wanted).groupBy("point_id").agg(F.count("*").alias("rows"))


# --- features ------------------------------------------------------------------------

FEATURE_COLUMNS = (
    "series_key", "observed_at", "segment", *features.FEATURE_SETS["E2"],
    *[f"target_h{h}" for h in (1, 3, 6)], *[f"usable_h{h}" for h in (1, 3, 6)],
    "is_imputed_t", "source_record_id_t", "rain_point_count",
)
FEATURE_SQL = f"SELECT {', '.join(FEATURE_COLUMNS)} FROM features"


@query("feature_matrix", f"WITH {S.features(S.TYPE, 1)} {FEATURE_SQL}")
def feature_matrix(spark, sf):
    return features.feature_matrix(filled(spark, sf, "event_type", 1), rain(spark, sf)).select(*FEATURE_COLUMNS)


@query("station_feature_matrix", f"WITH {S.features(S.USER, 2)} {FEATURE_SQL}")
def station_feature_matrix(spark, sf):
    return matrix(spark, sf, "user_id").select(*FEATURE_COLUMNS)


@query(
    "experiment_features",
    f"WITH {S.features(S.TYPE, 1)} SELECT series_key, observed_at, {', '.join(features.FEATURE_SETS['E1'])} FROM features",
)
def experiment_features(spark, sf):
    m = features.feature_matrix(filled(spark, sf, "event_type", 1), rain(spark, sf))
    return m.select("series_key", "observed_at", *features.experiment_features(m, "E1"))


LADDER_SQL = " UNION ALL ".join(
    f"""SELECT series_key, CAST({h} AS BIGINT) AS horizon, count(*) FILTER (level IS NOT NULL AND al{h} IS NOT NULL) AS finite_pairs,
  count(*) FILTER (level IS NOT NULL AND al{h} IS NOT NULL AND NOT ai{h}) AS after_imputed_targets,
  count(*) FILTER (level IS NOT NULL AND al{h} IS NOT NULL AND NOT ai{h} AND as{h} = segment) AS delivered,
  count(*) FILTER (level IS NOT NULL AND ai{h}) AS targets_lost_to_imputation FROM ahead GROUP BY 1"""
    for h in (1, 3, 6)
)


@query(
    "usability_ladder",
    f"""WITH {S.split(S.USER, 2)}, ahead AS (SELECT *,
  {", ".join(f"lead(level, {h}) OVER w AS al{h}, lead(imp, {h}) OVER w AS ai{h}, lead(segment, {h}) OVER w AS as{h}" for h in (1, 3, 6))}
  FROM split WINDOW w AS (PARTITION BY series_key ORDER BY pos)) {LADDER_SQL}""",
)
def usability_ladder(spark, sf):
    return features.usability_ladder(filled(spark, sf, "user_id"))


@query(
    "imputed_rows",
    f"WITH {S.grid(S.USER, 2)} SELECT series_key, tt AS observed_at, level AS water_level_m FROM grid WHERE imp",
)
def imputed_rows(spark, sf):
    return features.imputed_rows(filled(spark, sf, "user_id"))


@query(
    "rain_alignment",
    f"WITH {S.features(S.USER, 2)} SELECT series_key, rain_point_count, count(*) AS hours FROM features GROUP BY 1, 2",
)
def rain_alignment(spark, sf):
    return rainfall.alignment_evidence(matrix(spark, sf, "user_id"), ["series_key"])


@query(
    "usable_per_segment",
    f"""WITH {S.features(S.USER, 2)} SELECT series_key, segment, count(*) AS rows,
  count(*) FILTER (water_level_t IS NOT NULL AND NOT is_imputed_t) AS fit_rows,
  {", ".join(f"count(*) FILTER (usable_h{h}) AS usable_h{h}" for h in (1, 3, 6))} FROM features GROUP BY 1, 2""",
)
def usable_per_segment(spark, sf):
    return features.usable_per_segment(matrix(spark, sf, "user_id"))


# --- forecasts and scores ------------------------------------------------------------


@query(
    "persistence_forecast",
    f"""WITH {S.persistence(S.TYPE, 1)} SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, segment, anchor, target,
  observed, prediction, imp AS is_imputed FROM fc""",
)
def persistence_forecast(spark, sf):
    return forecast.persistence_forecasts(split(spark, sf, "event_type", 1))


SCORE_SQL = """SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, segment, count(*) FILTER (ok) AS sample_count,
  avg(abs(prediction - observed)) FILTER (ok) AS mae,
  CASE WHEN count(*) FILTER (ok) > 0 THEN sqrt(sum((prediction - observed) * (prediction - observed)) FILTER (ok) / count(*) FILTER (ok)) END AS rmse,
  CASE WHEN var_pop(observed) FILTER (ok) > 0 THEN 1 - sum((prediction - observed) * (prediction - observed)) FILTER (ok)
    / (count(*) FILTER (ok) * var_pop(observed) FILTER (ok)) END AS r2,
  CASE WHEN var_pop(observed) FILTER (ok) > 0 THEN 1 - sum((prediction - observed) * (prediction - observed)) FILTER (ok)
    / (count(*) FILTER (ok) * var_pop(observed) FILTER (ok)) END AS nse,
  abs(max(observed) FILTER (ok) - max(prediction) FILTER (ok)) AS peak_absolute_error,
  count(*) FILTER (observed IS NOT NULL AND prediction IS NOT NULL AND imp) AS excluded_imputed,
  CASE WHEN count(*) FILTER (ok) = 0 THEN 'no_valid_pairs' END AS reason
FROM (SELECT *, observed IS NOT NULL AND prediction IS NOT NULL AND NOT imp AS ok FROM {source}) x GROUP BY 1, 2, 3, 4"""


@query("persistence_metrics", f"WITH {S.persistence(S.USER, 2)} {SCORE_SQL.format(source='fc')}")
def persistence_metrics(spark, sf):
    return metrics.regression_metrics(forecast.persistence_forecasts(split(spark, sf, "user_id")))


@query(
    "train_mean_metrics",
    f"""WITH {S.persistence(S.USER, 2)}, m AS (SELECT series_key, avg(level) AS c FROM split WHERE segment = 'train' AND NOT imp AND level IS NOT NULL GROUP BY 1),
flat AS (SELECT fc.series_key, 'train_mean' AS model, horizon, segment, observed, CASE WHEN prediction IS NOT NULL THEN c END AS prediction, imp
  FROM fc LEFT JOIN m ON fc.series_key = m.series_key) {SCORE_SQL.format(source='flat')}""",
)
def train_mean_metrics(spark, sf):
    parts = split(spark, sf, "user_id")
    flat = forecast.constant_forecasts(forecast.persistence_forecasts(parts), forecast.train_means(parts))
    return metrics.regression_metrics(flat)


@query(
    "paired_counts",
    f"""WITH {S.persistence(S.USER, 2)} SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon,
  count(*) FILTER (observed IS NOT NULL AND prediction IS NOT NULL) AS paired_rows,
  count(*) FILTER (observed IS NOT NULL AND prediction IS NOT NULL AND NOT imp) AS paired_observed_rows FROM fc GROUP BY 1, 2, 3""",
)
def paired_counts(spark, sf):
    return metrics.paired_counts(forecast.persistence_forecasts(split(spark, sf, "user_id")))


def both_models(m: DataFrame, fc: DataFrame) -> DataFrame:
    return fc.drop("is_imputed").unionByName(anchored(m))


BOTH_SQL = f"""WITH {S.features(S.TYPE, 2)},
fc AS ({" UNION ALL ".join(
    f"SELECT series_key, 'persistence' AS model, {h} AS horizon, segment, tt - INTERVAL {h} HOUR AS anchor, tt AS target, "
    f"level AS observed, lag(level, {h}) OVER (PARTITION BY series_key ORDER BY pos) AS prediction, imp FROM split" for h in (1, 3, 6))}),
scored AS (SELECT * EXCLUDE (imp) FROM fc WHERE observed IS NOT NULL AND prediction IS NOT NULL AND NOT imp),
both_models AS (SELECT * FROM scored UNION ALL {ANCHORED_SQL})"""


COMMON_SQL = f"""{BOTH_SQL}, shared AS (SELECT series_key, segment, horizon, target FROM both_models GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT model) = 2),
kept AS (SELECT b.* FROM both_models b SEMI JOIN shared s ON b.series_key = s.series_key AND b.segment = s.segment AND b.horizon = s.horizon AND b.target = s.target)
SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, segment, sample_count, mae, rmse, nse
FROM ({S.scores('kept', 'series_key, model, horizon, segment')}) x"""


@query("common_support_metrics", COMMON_SQL)
def common_support_metrics(spark, sf):
    m, fc = both_inputs(spark, sf)
    scores = metrics.common_support_metrics(both_models(m, fc), ["persistence", "anchor"])
    return scores.select("series_key", "model", "horizon", "segment", "sample_count", "mae", "rmse", "nse")


@query(
    "predictable_rows",
    f"""{BOTH_SQL}, wide AS (SELECT series_key, segment, horizon, anchor, max(observed) AS observed,
  max(CASE WHEN model = 'anchor' THEN prediction END) AS a, max(CASE WHEN model = 'persistence' THEN prediction END) AS p FROM both_models GROUP BY 1, 2, 3, 4)
SELECT w.series_key, w.segment, CAST(w.horizon AS BIGINT) AS horizon, count(*) AS sample_count, avg(abs(f.water_level_t - observed)) AS persistence_mae,
  avg(abs(a - observed)) AS anchor_mae FROM wide w LEFT JOIN features f ON f.series_key = w.series_key AND f.observed_at = w.anchor
WHERE a IS NOT NULL AND observed IS NOT NULL GROUP BY 1, 2, 3""",
)
def predictable_rows(spark, sf):
    m, fc = both_inputs(spark, sf)
    levels = m.select("series_key", "observed_at", "water_level_t")
    return metrics.predictable_rows(both_models(m, fc), levels, ["anchor"])


@query(
    "baseline_comparison",
    f"""{BOTH_SQL}, m AS ({S.scores('both_models', 'series_key, model, horizon, segment')})
SELECT a.series_key, a.model, CAST(a.horizon AS BIGINT) AS horizon, a.segment, a.mae, b.mae AS baseline_value, a.mae - b.mae AS mae_gap, a.mae < b.mae AS beats_baseline
FROM m a LEFT JOIN m b ON b.model = 'persistence' AND a.series_key = b.series_key AND a.horizon = b.horizon AND a.segment = b.segment WHERE a.model = 'anchor'""",
)
def baseline_comparison(spark, sf):
    columns = ["series_key", "model", "horizon", "segment", "mae"]
    m, fc = both_inputs(spark, sf)
    mine = metrics.regression_metrics(anchored(m)).select(*columns)
    base = metrics.regression_metrics(fc)
    return metrics.compare_with_baseline(mine, base)


@query(
    "seed_summary",
    f"""WITH {S.persistence(S.TYPE, 2)}, m AS ({S.scores('scored', 'series_key, model, horizon, segment')})
SELECT model, CAST(horizon AS BIGINT) AS horizon, segment, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(nse) AS nse_mean, stddev_pop(nse) AS nse_std,
  arg_min(sample_count, series_key) AS sample_count, string_agg(CAST(sample_count AS VARCHAR), ',' ORDER BY series_key) AS sample_counts_by_seed,
  CAST(NULL AS VARCHAR) AS reason FROM m GROUP BY 1, 2, 3""",
)
def seed_summary(spark, sf):
    per_seed = metrics.regression_metrics(scored(spark, sf))
    out = metrics.seed_summary(per_seed, ["model", "horizon", "segment"], "series_key", ["mae", "nse"])
    return out.withColumn("sample_counts_by_seed", F.array_join(F.col("sample_counts_by_seed").cast("array<string>"), ","))


@query(
    "metric_reconcile",
    f"""WITH {S.persistence(S.TYPE, 2)}, m AS ({S.scores('scored', 'series_key, model, horizon, segment')}),
r AS (SELECT series_key, model, horizon, segment, CASE WHEN horizon = 3 THEN sample_count + 1 ELSE sample_count END AS rc,
  CASE WHEN segment = 'test' THEN mae + 0.5 ELSE mae END AS mae, rmse, nse FROM m WHERE NOT (segment = 'validation' AND horizon = 6))
SELECT m.series_key, m.model, CAST(m.horizon AS BIGINT) AS horizon, m.segment, m.sample_count, rc AS reported_count,
  greatest(abs(m.mae - r.mae), abs(m.rmse - r.rmse), abs(m.nse - r.nse)) AS max_abs_difference,
  CASE WHEN r.model IS NULL THEN 'not_reported' WHEN m.sample_count <> rc THEN 'sample_count_differs'
    WHEN abs(m.mae - r.mae) > 1e-5 THEN 'above_tolerance' ELSE 'ok' END AS state
FROM m LEFT JOIN r ON m.series_key = r.series_key AND m.model = r.model AND m.horizon = r.horizon AND m.segment = r.segment""",
)
def metric_reconcile(spark, sf):
    mine = metrics.regression_metrics(scored(spark, sf))
    reported = (
        mine.filter(~((F.col("segment") == "validation") & (F.col("horizon") == 6)))
        .withColumn("sample_count", F.when(F.col("horizon") == 3, F.col("sample_count") + 1).otherwise(F.col("sample_count")))
        .withColumn("mae", F.when(F.col("segment") == "test", F.col("mae") + 0.5).otherwise(F.col("mae")))
    )
    return metrics.reconcile(mine, reported, ["series_key", "model", "horizon", "segment"], ("mae", "rmse", "nse"))


@query(
    "missing_cells",
    f"""WITH {S.persistence(S.USER, 2)}, k AS (SELECT DISTINCT series_key FROM grid),
e AS (SELECT series_key, 'persistence' AS model, h AS horizon, s AS segment FROM k, (VALUES (1), (3), (6)) a(h), (VALUES ('train'), ('validation'), ('test')) b(s))
SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, segment FROM e
WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.series_key = e.series_key AND s.horizon = e.horizon AND s.segment = e.segment)""",
)
def missing_cells(spark, sf):
    series = observations(spark, sf, "user_id").select("series_key").distinct()
    expected = quality.with_axes(series, model=["persistence"], horizon=[1, 3, 6], segment=list(grid.SEGMENTS))
    return metrics.missing_cells(expected, scored(spark, sf, "user_id"), ["series_key", "model", "horizon", "segment"])


@query(
    "imputation_profile",
    f"""WITH {S.features(S.USER, 2)}, a AS ({ANCHORED_SQL}),
f AS (SELECT series_key, segment, observed_at, {" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in features.FEATURE_SETS["E2"])} AS e FROM features),
j AS (SELECT a.series_key, a.model, a.horizon, a.segment, count(*) AS usable_rows, count(*) FILTER (f.e IS NULL) AS unmatched_rows,
  count(*) FILTER (f.e > 0) AS rows_with_missing_features, CAST(COALESCE(sum(f.e), 0) AS BIGINT) AS missing_feature_cells
  FROM a LEFT JOIN f ON f.series_key = a.series_key AND f.segment = a.segment AND f.observed_at = a.anchor GROUP BY 1, 2, 3, 4)
SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, segment, usable_rows, unmatched_rows, rows_with_missing_features, missing_feature_cells,
  usable_rows * 20 AS input_cells, missing_feature_cells / CAST(usable_rows * 20 AS DOUBLE) AS missing_cell_share,
  rows_with_missing_features AS imputed_rows, missing_feature_cells AS imputed_cells FROM j""",
)
def imputation_profile(spark, sf):
    m = stored(matrix(spark, sf, "user_id"), "features")
    return metrics.imputation_profile(anchored(m), m, features.FEATURE_SETS["E2"])


# --- events --------------------------------------------------------------------------


def thresholds(spark, sf, q=0.9) -> DataFrame:
    return events.fit_thresholds(labelled_levels(split(spark, sf)), q)


@query("high_level_thresholds", f"WITH {S.split(S.USER, 2)}, {S.thresholds(0.9)} SELECT * FROM th")
def high_level_thresholds(spark, sf):
    return events.fit_thresholds(labelled_levels(split(spark, sf, "user_id")), 0.9)


@query("threshold_sensitivity", f"WITH {S.split(S.TYPE, 2)}, {S.thresholds(0.8)} SELECT * FROM th")
def threshold_sensitivity(spark, sf):
    return thresholds(spark, sf, 0.8)


EVENT_CTE = f"""{S.thresholds(0.9)},
ev0 AS (SELECT s.series_key, s.segment, s.tt, s.level >= threshold AS f FROM split s JOIN th ON s.series_key = th.series_key
  WHERE s.level IS NOT NULL AND NOT s.imp),
ev AS (SELECT series_key, segment, run_start AS event_start, run_end AS event_end, run_length AS event_points
  FROM ({S.runs('ev0', 'f', 'tt', 'series_key, segment')}) q)"""


@query("event_runs", f"WITH {S.split(S.TYPE, 1)}, {EVENT_CTE} SELECT * FROM ev")
def event_runs(spark, sf):
    m = stored(matrix(spark, sf, "event_type", 1), "features")
    return events.event_windows(m, events.fit_thresholds(m))


@query(
    "event_summary",
    f"""WITH {S.split(S.TYPE, 1)}, {EVENT_CTE},
b AS (SELECT s.series_key, s.segment, threshold, count(*) AS hours, count(*) FILTER (level IS NOT NULL AND NOT imp) AS usable_observations,
  max(level) FILTER (NOT imp) AS max_level, count(*) FILTER (level >= threshold AND NOT imp) AS event_points FROM split s JOIN th ON s.series_key = th.series_key GROUP BY 1, 2, 3)
SELECT b.*, (SELECT count(*) FROM ev WHERE ev.series_key = b.series_key AND ev.segment = b.segment) AS event_segments FROM b""",
)
def event_summary(spark, sf):
    m = stored(matrix(spark, sf, "event_type", 1), "features")
    return events.event_summary(m, events.fit_thresholds(m))


METRIC_CTE = f"""{S.thresholds(0.9)},
lab AS (SELECT s.*, observed >= threshold AS o, prediction >= threshold AS p FROM scored s JOIN th ON s.series_key = th.series_key),
st AS (SELECT *, o AND NOT COALESCE(lag(o) OVER w, FALSE) AS os, p AND NOT COALESCE(lag(p) OVER w, FALSE) AS ps FROM lab
  WINDOW w AS (PARTITION BY series_key, horizon, segment ORDER BY target)),
em AS (SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, segment, count(*) FILTER (o AND p) AS tp, count(*) FILTER (p AND NOT o) AS fp, count(*) FILTER (o AND NOT p) AS fn,
  count(*) FILTER (o) AS observed_event_points, count(*) FILTER (os) AS observed_event_segments, count(*) FILTER (p) AS predicted_event_points,
  count(*) FILTER (ps) AS predicted_event_segments FROM st GROUP BY 1, 2, 3, 4),
cells AS (SELECT *, CASE WHEN observed_event_points > 0 AND predicted_event_points > 0 THEN tp / CAST(predicted_event_points AS DOUBLE) END AS precision,
  CASE WHEN observed_event_points > 0 AND predicted_event_points > 0 THEN tp / CAST(observed_event_points AS DOUBLE) END AS recall,
  CASE WHEN observed_event_points > 0 AND predicted_event_points > 0 THEN 2 * tp / CAST(observed_event_points + predicted_event_points AS DOUBLE) END AS f1,
  CASE WHEN observed_event_points = 0 THEN 'no_observed_events' WHEN predicted_event_points = 0 THEN 'no_predicted_events' END AS reason FROM em)"""


@query("event_metrics", f"WITH {S.persistence(S.USER, 2)}, {METRIC_CTE} SELECT * FROM cells")
def event_metrics(spark, sf):
    levels, fc = split_and_scored(spark, sf, "user_id")
    return events.event_metrics(fc, events.fit_thresholds(levels))


@query("nested_metrics_flatten", f"WITH {S.persistence(S.TYPE, 2)}, {METRIC_CTE} SELECT * FROM cells")
def nested_metrics_flatten(spark, sf):
    levels, fc = split_and_scored(spark, sf)
    cells = events.event_metrics(fc, events.fit_thresholds(levels))
    inner = F.struct(*[c for c in cells.columns if c not in ("series_key", "model", "horizon", "segment")])

    def nest(df, keys, key, value):
        entries = F.map_from_entries(F.collect_list(F.struct(key, value)))
        return df.groupBy(*keys).agg(entries.alias("v"))

    by_model = nest(cells, ["series_key", "segment", "horizon"], F.col("model"), inner)
    by_horizon = nest(by_model, ["series_key", "segment"], F.concat(F.lit("h"), F.col("horizon")), F.col("v"))
    by_segment = nest(by_horizon, ["series_key"], F.col("segment"), F.col("v"))
    documents = by_segment.select("series_key", F.to_json("v").alias("document"))
    return metrics.flatten_event_metrics(documents)


@query(
    "peak_diagnostics",
    f"""WITH {S.persistence(S.USER, 2)},
po AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY series_key, horizon, segment ORDER BY observed DESC, target) = 1),
pp AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY series_key, horizon, segment ORDER BY prediction DESC, target) = 1),
pe AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY series_key, horizon, segment ORDER BY abs(prediction - observed) DESC, target) = 1),
n AS (SELECT series_key, horizon, segment, count(*) AS c FROM scored GROUP BY 1, 2, 3)
SELECT po.series_key, po.model, CAST(po.horizon AS BIGINT) AS horizon, po.segment, c AS sample_count, po.observed AS observed_peak, po.target AS observed_peak_time,
  po.prediction AS prediction_at_peak, po.observed - po.prediction AS underestimation, abs(pe.prediction - pe.observed) AS max_absolute_error,
  pe.target AS max_absolute_error_time, CASE WHEN pe.prediction < pe.observed THEN 'under' WHEN pe.prediction > pe.observed THEN 'over' ELSE 'none' END AS max_absolute_error_direction,
  CAST(date_diff('hour', po.target, pp.target) AS BIGINT) AS peak_lag_hours
FROM po JOIN pp USING (series_key, horizon, segment) JOIN pe USING (series_key, horizon, segment) JOIN n USING (series_key, horizon, segment)""",
)
def peak_diagnostics(spark, sf):
    return events.peak_diagnostics(scored(spark, sf, "user_id"))


@query(
    "warning_lead",
    f"""WITH {S.persistence(S.TYPE, 2)}, {METRIC_CTE},
rn AS (SELECT *, row_number() OVER (PARTITION BY series_key, horizon, segment ORDER BY target)
  - row_number() OVER (PARTITION BY series_key, horizon, segment, o ORDER BY target) AS island FROM lab),
r AS (SELECT series_key, model, horizon, segment, min(target) AS event_start, max(target) AS event_end, count(*) AS event_points,
  min(anchor) FILTER (p) AS ia, arg_min(target, anchor) FILTER (p) AS it, arg_min(prediction, anchor) FILTER (p) AS ip
  FROM rn WHERE o GROUP BY series_key, model, horizon, segment, island)
SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, segment, event_start, event_end, event_points,
  CASE WHEN ia < event_start THEN CAST(date_diff('hour', ia, event_start) AS BIGINT) END AS lead_hours, ia AS first_issue_time, it AS first_target_time,
  ip AS first_prediction, CASE WHEN ia IS NULL THEN 'no_prediction_above_threshold' WHEN ia >= event_start THEN 'crossing_after_event_start' END AS reason FROM r""",
)
def warning_lead(spark, sf):
    levels, fc = split_and_scored(spark, sf)
    return events.warning_leads(fc, events.fit_thresholds(levels))


@query(
    "event_errors",
    f"""WITH {S.persistence(S.TYPE, 1)}, {EVENT_CTE}, h AS (SELECT DISTINCT series_key, segment, model, horizon FROM scored),
cell AS (SELECT ev.*, model, horizon FROM ev JOIN h ON ev.series_key = h.series_key AND ev.segment = h.segment),
j AS (SELECT c.*, s.observed, s.prediction, s.target FROM cell c LEFT JOIN scored s ON s.series_key = c.series_key AND s.segment = c.segment
  AND s.model = c.model AND s.horizon = c.horizon AND s.target BETWEEN c.event_start AND c.event_end)
SELECT series_key, segment, event_start, event_end, event_points, model, CAST(horizon AS BIGINT) AS horizon, count(observed) AS sample_count,
  avg(abs(prediction - observed)) AS mae, max(observed) AS observed_peak, arg_max(prediction, observed) AS peak_prediction,
  max(observed) - arg_max(prediction, observed) AS peak_underestimation, CASE WHEN count(observed) = 0 THEN 'no_valid_pairs' END AS reason
FROM j GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def event_errors(spark, sf):
    levels, fc = split_and_scored(spark, sf, "event_type", 1)
    return events.event_errors(fc, events.event_windows(levels, events.fit_thresholds(levels)))


@query(
    "residual_rows",
    f"""WITH {S.persistence(S.USER, 2)} SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, target, abs(prediction - observed) AS absolute_error,
  prediction - observed AS signed_error, CASE WHEN prediction < observed THEN 'under' WHEN prediction > observed THEN 'over' ELSE 'none' END AS direction
FROM scored WHERE segment = 'test' AND target {FOCUS_SQL}""",
)
def residual_rows(spark, sf):
    return events.residual_rows(scored(spark, sf, "user_id"), *FOCUS).select(
        "series_key", "model", "horizon", "target", "absolute_error", "signed_error", "direction"
    )


@query(
    "phase_error",
    f"""WITH {S.persistence(S.USER, 2)}, w AS (SELECT *, observed - lag(observed) OVER (PARTITION BY series_key, horizon ORDER BY target) AS d
  FROM scored WHERE segment = 'test' AND target {FOCUS_SQL}),
c AS (SELECT series_key, model, horizon, count(*) AS n, count(*) FILTER (d > 0) AS rn, avg(abs(prediction - observed)) FILTER (d > 0) AS rm,
  avg(prediction - observed) FILTER (d > 0) AS rs, count(*) FILTER (d < 0) AS fnn, avg(abs(prediction - observed)) FILTER (d < 0) AS fm,
  avg(prediction - observed) FILTER (d < 0) AS fs FROM w GROUP BY 1, 2, 3)
SELECT series_key, model, CAST(horizon AS BIGINT) AS horizon, 'rising' AS phase, CASE WHEN n >= 2 THEN rn ELSE 0 END AS sample_count, rm AS mae, rs AS mean_signed_error,
  CASE WHEN n < 2 THEN 'no_valid_pairs' END AS reason FROM c
UNION ALL SELECT series_key, model, CAST(horizon AS BIGINT), 'falling', CASE WHEN n >= 2 THEN fnn ELSE 0 END, fm, fs, CASE WHEN n < 2 THEN 'no_valid_pairs' END FROM c""",
)
def phase_error(spark, sf):
    return events.phase_errors(scored(spark, sf, "user_id"), *FOCUS)


@query(
    "max_change",
    f"""WITH {S.obs(S.USER)}, w AS (SELECT series_key, tt, level - lag(level) OVER (PARTITION BY series_key ORDER BY tt) AS d FROM obs WHERE tt {FOCUS_SQL}),
b AS (SELECT series_key, tt, d FROM w WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY abs(d) DESC, tt) = 1),
k AS (SELECT DISTINCT series_key FROM w)
SELECT k.series_key, d AS value, tt AS at_target, CASE WHEN d > 0 THEN 'rising' WHEN d IS NOT NULL THEN 'falling' END AS direction FROM k LEFT JOIN b USING (series_key)""",
)
def max_change(spark, sf):
    return events.largest_change(
        observations(spark, sf, "user_id"), *FOCUS, time="observed_at", level="water_level_m",
        block_us=6 * timeline.HOUR_US,
    )


# --- serving -------------------------------------------------------------------------


@query(
    "asof_latest",
    """WITH q AS (SELECT event_id, CAST(user_id AS VARCHAR) AS series_key, date_trunc('day', ts) + INTERVAL 12 HOUR AS as_of FROM events),
o AS (SELECT CAST(user_id AS VARCHAR) AS series_key, ts AS observed_at, value AS water_level_m FROM events)
SELECT q.event_id, q.series_key, q.as_of, o.observed_at, o.water_level_m FROM q ASOF LEFT JOIN o ON q.series_key = o.series_key AND q.as_of >= o.observed_at""",
)
def asof_latest(spark, sf):
    asked = table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("series_key"),
        (F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 12 hours")).alias("as_of"),
    )
    return forecast.asof_join(asked, observations(spark, sf, "user_id"))


@query(
    "freshness",
    f"""WITH {S.obs(S.USER)}, l AS (SELECT series_key, max(tt) AS observed_at, arg_max(level, tt) AS water_level_m FROM obs WHERE tt <= {AS_OF_SQL} GROUP BY 1)
SELECT *, (epoch_us({AS_OF_SQL}) - epoch_us(observed_at)) / 6e7 AS data_age_minutes,
  CASE WHEN (epoch_us({AS_OF_SQL}) - epoch_us(observed_at)) / 6e7 > 180 THEN 'stale' ELSE 'fresh' END AS freshness FROM l""",
)
def freshness(spark, sf):
    latest = forecast.latest_before(observations(spark, sf, "user_id"), AS_OF)
    return risk.with_freshness(latest, F.lit(AS_OF), 180)


def artifacts(spark, sf) -> DataFrame:
    """Stored predictions derived from the daily means of each user: one artifact per series and priority."""
    obs = observations(spark, sf, "user_id").filter(F.col("observed_at") <= F.lit(AS_OF))
    level = obs.groupBy("series_key").agg(
        F.avg("water_level_m").alias("m"), F.count("*").alias("n"), F.max("observed_at").alias("anchor_at")
    )
    # Series with fewer readings store fewer horizons.
    points = F.array(
        *[
            F.when(
                F.col("n") >= need,
                F.struct(
                    F.lit(h).alias("horizon"), F.lit(AS_OF + dt.timedelta(hours=h)).alias("target_at"),
                    (F.col("m") + h).alias("water_level_m"),
                ),
            )
            for h, need in ((1, 1), (3, 30), (6, 40))
        ]
    )
    return level.select(
        "series_key", F.lit("ridge").alias("model"), F.lit("v1").alias("model_version"),
        F.col("anchor_at").alias("as_of"), "anchor_at", F.lit(1).alias("priority"),
        F.array_compact(points).alias("points"),
    )


def served(spark, sf) -> DataFrame:
    latest = forecast.latest_before(observations(spark, sf, "user_id"), AS_OF)
    base = forecast.served_persistence(latest, F.lit(AS_OF), (1, 3, 6), "1h")
    points = forecast.artifact_points(artifacts(spark, sf), AS_OF)
    return forecast.choose_forecasts(base, points, "ridge", (1, 3, 6))


SERVED_CTE = f"""{S.obs(S.USER)}, lv AS (SELECT series_key, max(tt) AS anchor_at, arg_max(level, tt) AS lvl, avg(level) AS m, count(*) AS c FROM obs WHERE tt <= {AS_OF_SQL} GROUP BY 1),
served AS (SELECT series_key, CAST(h AS BIGINT) AS horizon, anchor_at, {AS_OF_SQL} + h * INTERVAL 1 HOUR AS target_at,
  CASE WHEN c >= 40 THEN m + h ELSE lvl END AS water_level_m, CASE WHEN c >= 40 THEN 'ridge' ELSE 'persistence' END AS model,
  CASE WHEN c >= 40 THEN 'v1' END AS model_version, CASE WHEN c >= 40 THEN 'ok' ELSE 'degraded' END AS status,
  CASE WHEN c < 40 THEN 'model_artifact_unavailable' END AS fallback_reason FROM lv, (VALUES (1), (3), (6)) v(h))"""


@query("forecast_fallback", f"WITH {SERVED_CTE} SELECT * FROM served")
def forecast_fallback(spark, sf):
    return served(spark, sf)


def user_thresholds(spark, sf) -> DataFrame:
    return events.fit_thresholds(labelled_levels(split(spark, sf, "user_id")), 0.9)


RISK_SQL = f"""WITH {SERVED_CTE}, {S.split(S.USER, 2).replace(S.obs(S.USER) + ",", "")}, {S.thresholds(0.9)},
mp AS (SELECT series_key, max(CASE WHEN horizon = 1 THEN water_level_m END) AS p1, max(CASE WHEN horizon = 3 THEN water_level_m END) AS p3,
  max(CASE WHEN horizon = 6 THEN water_level_m END) AS p6, max(model) AS model, max(status) AS st, max(fallback_reason) AS fallback_reason, max(anchor_at) AS tt FROM served GROUP BY 1)
SELECT mp.series_key, mp.tt AS observed_at, lv.lvl AS water_level_m, (epoch_us({AS_OF_SQL}) - epoch_us(mp.tt)) / 6e7 AS data_age_minutes,
  CASE WHEN (epoch_us({AS_OF_SQL}) - epoch_us(mp.tt)) / 6e7 > 180 THEN 'stale' ELSE 'fresh' END AS freshness, p1, p3, p6, model,
  CASE WHEN st = 'ok' AND (epoch_us({AS_OF_SQL}) - epoch_us(mp.tt)) / 6e7 > 180 THEN 'degraded' ELSE st END AS status, fallback_reason, threshold,
  {AS_OF_SQL} AS generated_at, concat_ws(',', CASE WHEN p1 >= threshold THEN '1' END, CASE WHEN p3 >= threshold THEN '3' END, CASE WHEN p6 >= threshold THEN '6' END) AS triggered,
  CASE WHEN p1 >= threshold THEN 'elevated' WHEN p3 >= threshold OR p6 >= threshold THEN 'watch' ELSE 'normal' END AS level,
  round_even((epoch_us({AS_OF_SQL}) - epoch_us(mp.tt)) / 3.6e9, 6) AS data_age_hours, (epoch_us({AS_OF_SQL}) - epoch_us(mp.tt)) / 3.6e9 > 3 AS is_stale
FROM mp JOIN lv USING (series_key) LEFT JOIN th USING (series_key)"""


@query("station_bundle", RISK_SQL)
def station_bundle(spark, sf):
    latest = forecast.latest_before(observations(spark, sf, "user_id"), AS_OF)
    bundle = risk.station_bundle(
        latest, served(spark, sf), user_thresholds(spark, sf), as_of=F.lit(AS_OF), stale_after_minutes=180
    )
    out = bundle.withColumns({f"p{h}": F.try_element_at("predictions", F.lit(h)) for h in (1, 3, 6)})
    return out.withColumn("triggered", F.array_join(F.col("triggered_horizons").cast("array<string>"), ",")).drop(
        "predictions", "triggered_horizons", "missing_horizons"
    )


@query(
    "risk_levels",
    f"""WITH {S.persistence(S.USER, 2)}, {S.thresholds(0.9)}, w AS (SELECT series_key, target, max(CASE WHEN horizon = 1 THEN prediction END) AS p1,
  max(CASE WHEN horizon = 3 THEN prediction END) AS p3, max(CASE WHEN horizon = 6 THEN prediction END) AS p6 FROM fc GROUP BY 1, 2)
SELECT w.series_key, target, threshold, concat_ws(',', CASE WHEN p1 IS NULL THEN '1' END, CASE WHEN p3 IS NULL THEN '3' END, CASE WHEN p6 IS NULL THEN '6' END) AS missing,
  CASE WHEN p1 IS NULL AND p3 IS NULL AND p6 IS NULL THEN NULL WHEN p1 >= threshold THEN 'elevated' WHEN p3 >= threshold OR p6 >= threshold THEN 'watch' ELSE 'normal' END AS level
FROM w JOIN th USING (series_key)""",
)
def risk_levels(spark, sf):
    fc = forecast.persistence_forecasts(split(spark, sf, "user_id"))
    maps = risk.forecast_maps(fc, ["series_key", "target"], "prediction")
    requests = maps.join(user_thresholds(spark, sf), ["series_key"]).withColumns(
        {"anchor_at": F.col("target"), "last_observed_at": F.col("target")}
    )
    return risk.risk_levels(requests).select(
        "series_key", "target", "threshold",
        F.array_join(F.col("missing_horizons").cast("array<string>"), ",").alias("missing"), "level",
    )


# --- models --------------------------------------------------------------------------

E1 = features.FEATURE_SETS["E1"]
E2 = features.FEATURE_SETS["E2"]


def samples(spark, sf, columns=E2, key="event_type") -> DataFrame:
    return models.segment_samples(matrix(spark, sf, key), columns)


def samples_sql(columns, key=S.TYPE) -> str:
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"
    parts = " UNION ALL ".join(
        f"SELECT series_key, segment, observed_at, CAST({h} AS BIGINT) AS horizon, target_h{h} AS y, {x} AS x FROM features WHERE usable_h{h}"
        for h in (1, 3, 6)
    )
    return f"WITH {S.features(key, 2)}, samples AS ({parts})"


@query(
    "sample_counters",
    f"""{samples_sql(E2, S.USER)} SELECT series_key, segment, horizon, count(*) AS usable_rows,
  count(*) FILTER (list_count(x) < 20) AS missing_feature_rows, CAST(sum(20 - list_count(x)) AS BIGINT) AS missing_feature_cells,
  count(*) FILTER (y IS NULL) AS bad_targets FROM samples GROUP BY 1, 2, 3""",
)
def sample_counters(spark, sf):
    return models.sample_counters(samples(spark, sf, E2, "user_id"))


@query(
    "feature_statistics",
    f"""{samples_sql(E1)}, v AS (SELECT series_key, horizon, unnest(x) AS v, unnest(range(9)) AS feature FROM samples
  WHERE segment = 'train' AND list_count(x) = 9)
SELECT series_key, horizon, count(*) AS fit_rows, feature, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS scale
FROM v GROUP BY series_key, horizon, feature""",
)
def feature_statistics(spark, sf):
    stats = models.feature_statistics(samples(spark, sf, E1), len(E1))
    return stats.select(
        "series_key", "horizon", "fit_rows", F.posexplode(F.arrays_zip("mean", "scale")).alias("feature", "s")
    ).select("series_key", "horizon", "fit_rows", "feature", "s.mean", "s.scale")


@query(
    "train_medians",
    f"""{samples_sql(E2)}, v AS (SELECT series_key, horizon, unnest(x) AS v, unnest(range(20)) AS feature FROM samples WHERE segment = 'train')
SELECT series_key, horizon, feature, median(v) AS median FROM v WHERE v IS NOT NULL GROUP BY 1, 2, 3""",
)
def train_medians(spark, sf):
    medians = models.train_medians(samples(spark, sf))
    return medians.select("series_key", "horizon", F.posexplode("medians").alias("feature", "median"))


@query(
    "filled_samples",
    f"""{samples_sql(E2)}, v AS (SELECT series_key, horizon, unnest(x) AS v, unnest(range(20)) AS feature FROM samples WHERE segment = 'train'),
md AS (SELECT series_key, horizon, feature, median(v) AS m FROM v WHERE v IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT series_key, segment, horizon, unnest(x) AS v, unnest(range(20)) AS feature FROM samples)
SELECT a.series_key, a.segment, a.horizon, count(*) / 20 AS rows, count(*) FILTER (v IS NULL) AS imputed_cells, sum(COALESCE(v, m)) AS total
FROM a JOIN md ON a.series_key = md.series_key AND a.horizon = md.horizon AND a.feature = md.feature GROUP BY 1, 2, 3""",
)
def filled_samples(spark, sf):
    rows = stored(samples(spark, sf), "samples")
    filled_rows = models.fill_missing(rows, models.train_medians(rows))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return filled_rows.groupBy("series_key", "segment", "horizon").agg(
        F.count("*").cast("double").alias("rows"), F.sum("imputed_cells").alias("imputed_cells"), F.sum(total).alias("total")
    )


@query(
    "moment_matrices",
    f"""{samples_sql(E1)}, r AS (SELECT series_key, horizon, list_concat([1.0::DOUBLE], x, [y]) AS r FROM samples WHERE segment = 'train' AND list_count(x) = 9),
o AS (SELECT series_key, horizon, r, unnest(r) AS a, unnest(range(11)) AS i FROM r),
p AS (SELECT series_key, horizon, a, i, unnest(r) AS b, unnest(range(11)) AS j FROM o)
SELECT series_key, horizon, i * 11 + j AS cell, sum(a * b) AS moment FROM p GROUP BY 1, 2, 3""",
)
def moment_matrices(spark, sf):
    cells = models.moment_matrices(samples(spark, sf, E1))
    return cells.select("series_key", "horizon", F.posexplode("moments").alias("cell", "moment"))


# Ridge from the moment matrix of (1, x, y), solved by elimination. Cell (i, j) of the 11 by 11
# matrix is f[i * 11 + j + 1]; the system of a penalty is 9 rows of 10 numbers.
RIDGE_CTE = f"""{samples_sql(E1).replace("WITH ", "", 1)},
rr AS (SELECT series_key, horizon, list_concat([1.0::DOUBLE], x, [y]) AS r FROM samples WHERE segment = 'train' AND list_count(x) = 9),
ro AS (SELECT series_key, horizon, r, unnest(r) AS a, unnest(range(11)) AS i FROM rr),
rp AS (SELECT series_key, horizon, a, i, unnest(r) AS b, unnest(range(11)) AS j FROM ro),
rm AS (SELECT series_key, horizon, i, j, sum(a * b) AS v FROM rp GROUP BY 1, 2, 3, 4),
rf AS (SELECT series_key, horizon, list(v ORDER BY i, j) AS f FROM rm GROUP BY 1, 2),
rs AS (SELECT *, f[1] AS n, f[11] / f[1] AS y_mean, list_transform(range(1, 10), lambda i: f[i + 1] / f[1]) AS mean FROM rf),
rv AS (SELECT *, list_transform(range(1, 10), lambda i: f[i * 12 + 1] / n - mean[i] * mean[i]) AS var FROM rs),
rt AS (SELECT *, list_transform(range(1, 10), lambda i: var[i] <= 1e-12 * greatest(f[i * 12 + 1] / n, 1e-300)) AS flat FROM rv),
ru AS (SELECT *, list_transform(range(1, 10), lambda i: CASE WHEN flat[i] THEN 1.0 ELSE sqrt(var[i]) END) AS scale FROM rt),
ra AS (SELECT *, unnest([0.1, 1.0, 10.0, 100.0])::DOUBLE AS alpha FROM ru),
r0 AS (SELECT series_key, horizon, alpha, n, y_mean, mean, scale, list_transform(range(1, 10), lambda i: list_concat(
  list_transform(range(1, 10), lambda j: (CASE WHEN flat[i] OR flat[j] THEN 0.0 ELSE (f[i * 11 + j + 1] / n - mean[i] * mean[j]) / (scale[i] * scale[j]) * n END)
    + (CASE WHEN i = j THEN alpha ELSE 0.0 END)),
  [CASE WHEN flat[i] THEN 0.0 ELSE (f[i * 11 + 11] / n - mean[i] * y_mean) / scale[i] * n END])) AS m FROM ra),
re AS (SELECT *, 1 AS k FROM r0 UNION ALL
  SELECT series_key, horizon, alpha, n, y_mean, mean, scale, list_transform(range(1, 10), lambda i: list_transform(range(1, 11),
    lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] / m[k][k] * m[k][j] END)), k + 1 FROM re WHERE k <= 9),
fit AS (SELECT series_key, horizon, alpha, CAST(n AS BIGINT) AS fit_rows, y_mean AS intercept, list_transform(range(1, 10), lambda i: m[i][10]) AS w,
  list_transform(range(1, 10), lambda i: m[i][10] / scale[i]) AS slopes, mean FROM re WHERE k = 10),
off AS (SELECT *, intercept - list_sum(list_transform(range(1, 10), lambda i: slopes[i] * mean[i])) AS shift FROM fit),
val AS (SELECT s.series_key, s.horizon, o.alpha, avg(abs(shift + list_sum(list_transform(range(1, 10), lambda i: slopes[i] * x[i])) - y)) AS validation_mae
  FROM samples s JOIN off o ON s.series_key = o.series_key AND s.horizon = o.horizon WHERE segment = 'validation' AND list_count(x) = 9 GROUP BY 1, 2, 3),
best AS (SELECT o.*, v.validation_mae FROM off o LEFT JOIN val v ON o.series_key = v.series_key AND o.horizon = v.horizon AND o.alpha = v.alpha
  QUALIFY row_number() OVER (PARTITION BY o.series_key, o.horizon ORDER BY v.validation_mae NULLS LAST, o.alpha) = 1)"""


@query(
    "ridge_fit",
    f"WITH RECURSIVE {RIDGE_CTE} SELECT series_key, horizon, alpha, fit_rows, intercept, unnest(range(9)) AS feature, unnest(w) AS weight FROM off",
)
def ridge_fit(spark, sf):
    fitted = models.fit_ridge(samples(spark, sf, E1))
    return fitted.select("series_key", "horizon", "alpha", "fit_rows", "intercept", F.posexplode("coefficients").alias("feature", "weight"))


def best_ridge(spark, sf):
    rows = stored(samples(spark, sf, E1), "samples")
    return rows, models.select_alpha(rows, models.fit_ridge(rows))


@query("ridge_select", f"WITH RECURSIVE {RIDGE_CTE} SELECT series_key, horizon, alpha, fit_rows, validation_mae FROM best")
def ridge_select(spark, sf):
    return best_ridge(spark, sf)[1].select("series_key", "horizon", "alpha", "fit_rows", "validation_mae")


@query(
    "ridge_metrics",
    f"""WITH RECURSIVE {RIDGE_CTE}, told AS (SELECT s.series_key, 'ridge' AS model, s.horizon, s.segment, s.y AS observed, FALSE AS imp,
  CASE WHEN list_count(x) = 9 THEN shift + list_sum(list_transform(range(1, 10), lambda i: slopes[i] * x[i])) END AS prediction
  FROM samples s JOIN best b ON s.series_key = b.series_key AND s.horizon = b.horizon) {SCORE_SQL.format(source='told')}""",
)
def ridge_metrics(spark, sf):
    rows, best = best_ridge(spark, sf)
    scores = models.ridge_predictions(rows, best).withColumn("model", F.lit("ridge"))
    return metrics.regression_metrics(scores)


@query(
    "tree_metrics",
    f"""{samples_sql(E2)} SELECT series_key, 'trees' AS model, horizon, segment, CAST(6 * count(*) AS BIGINT) AS sample_count, CAST(NULL AS VARCHAR) AS reason,
  CASE WHEN segment = 'train' THEN TRUE END AS train_explained FROM samples GROUP BY series_key, horizon, segment""",
)
def tree_metrics(spark, sf):
    """What the scores of trees hold that does not depend on the fit: every row of both feature sets and all seeds is predicted,
    and on the train rows of a horizon trees are nearer than the mean."""
    predictions = stored(models.run_experiments(stored(matrix(spark, sf), "features"), models=["trees"]), "predictions")
    off = F.col("prediction") - F.col("observed")
    explained = predictions.groupBy("horizon").agg(
        (F.avg(F.when(F.col("segment") == "train", off * off)) < F.var_pop(F.when(F.col("segment") == "train", F.col("observed")))).alias("known")
    )
    scores = metrics.regression_metrics(predictions).select("series_key", "model", "horizon", "segment", "sample_count", "reason")
    return scores.join(explained, "horizon").withColumn("train_explained", F.when(F.col("segment") == "train", F.col("known"))).drop("known")


def _cells(experiment: str, columns) -> str:
    width = len(columns)
    whole = f"count(*) FILTER (list_count(x) = {width})"
    return f"""SELECT series_key, '{experiment}' AS experiment, model, horizon, segment, CASE WHEN model = 'ridge' THEN {whole} ELSE count(*) END AS sample_count,
  CASE WHEN model = 'ridge' AND {whole} = 0 THEN 'no_valid_pairs' END AS reason, CASE WHEN model = 'ridge' AND {whole} > 0 THEN TRUE END AS without_spread
  FROM ({samples_sql(columns)} SELECT * FROM samples) s, (VALUES ('ridge'), ('trees')) m(model) GROUP BY series_key, model, horizon, segment
  QUALIFY model = 'trees' OR sum(count(*) FILTER (segment = 'train' AND list_count(x) = {width})) OVER (PARTITION BY series_key, model, horizon) > 0"""


@query(
    "experiment_scores",
    f"""SELECT *, concat_ws(',', sample_count, sample_count, sample_count) AS sample_counts_by_seed
  FROM ({_cells("E1", E1)} UNION ALL {_cells("E2", E2)})""",
)
def experiment_scores(spark, sf):
    """Samples of every cell and seed, why a cell has none, and that ridge is the same for all seeds. The errors themselves
    depend on the fit: ``ridge_metrics`` checks those of ridge, ``tree_metrics`` bounds those of trees."""
    predictions = models.run_experiments(stored(matrix(spark, sf), "features"))
    out = models.experiment_scores(stored(predictions, "predictions"))
    return out.select(
        "series_key", "experiment", "model", "horizon", "segment", "sample_count", "reason",
        F.array_join(F.col("sample_counts_by_seed").cast("array<string>"), ",").alias("sample_counts_by_seed"),
        F.when(F.col("model") == "ridge", F.col("mae_std") < 1e-9).alias("without_spread"),
    )


# --- landed responses, pages, digests -------------------------------------------------


def daily_responses(spark, sf) -> DataFrame:
    """One nested response per point and day, as its JSON text (at most 24 entries each)."""
    hours = rain_points(spark, sf).withColumn("day", F.to_date("observed_at"))
    entry = F.struct(
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm").alias("time"), "precipitation_mm", "rain_mm"
    )
    days = hours.groupBy("point_id", "day").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    hourly = F.struct(
        F.col("h.time").alias("time"), F.col("h.precipitation_mm").alias("precipitation"), F.col("h.rain_mm").alias("rain")
    )
    body = days.select("point_id", F.to_json(F.struct(hourly.alias("hourly"))).alias("body"))
    return body.select("point_id", F.from_json("body", ARCHIVE_RESPONSE).alias("r")).select("point_id", "r.*")


@query(
    "archive_rows",
    f"WITH {S.RAIN_POINTS} SELECT point_id, tt AS observed_at, precipitation_mm, rain_mm FROM points",
)
def archive_rows(spark, sf):
    return responses.response_rows(daily_responses(spark, sf), ["point_id"])


@query(
    "archive_violations",
    f"""WITH {S.RAIN_POINTS}, d AS (SELECT point_id, date_diff('day', DATE '1970-01-01', CAST(tt AS DATE)) % 5 AS kind, count(*) AS n FROM points GROUP BY point_id, CAST(tt AS DATE)),
v AS (SELECT point_id, CASE WHEN kind = 0 AND n > 1 THEN 'time_not_increasing' WHEN kind = 1 THEN 'length_rain' WHEN kind = 2 THEN 'missing_rain' WHEN kind = 3 THEN 'unparsable_time' END AS violation FROM d)
SELECT point_id, violation, count(*) AS responses FROM v WHERE violation IS NOT NULL GROUP BY 1, 2""",
)
def archive_violations(spark, sf):
    """Responses of four days in five are spoilt: times backwards, an array too short, one missing, a time that is none."""
    days = daily_responses(spark, sf)
    kind = F.pmod(F.unix_date(F.to_date(F.col("hourly.time")[0].cast("timestamp"))), F.lit(5))
    time, rain_mm = F.col("hourly.time"), F.col("hourly.rain")
    spoilt = F.struct(
        F.when(kind == 0, F.reverse(time)).when(kind == 3, F.transform(time, lambda t, i: F.when(i == 0, F.lit("soon")).otherwise(t))).otherwise(time).alias("time"),
        F.col("hourly.precipitation").alias("precipitation"),
        F.when(kind == 1, F.slice(rain_mm, 1, F.size(rain_mm) - 1)).when(kind != 2, rain_mm).alias("rain"),
    )
    bad = responses.response_violations(days.withColumn("hourly", spoilt))
    return bad.groupBy("point_id", "violation").agg(F.count("*").alias("responses"))


@query(
    "paged_landing",
    """WITH p AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM conversations),
t AS (SELECT conv_id, greatest(CAST(sum(len(words)) AS BIGINT) - 5, 0) AS total, min(turn) FILTER (len(words) = 0) AS stop FROM p GROUP BY 1),
b AS (SELECT p.*, total, stop, COALESCE(sum(len(words)) OVER (PARTITION BY p.conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM p JOIN t ON p.conv_id = t.conv_id),
x AS (SELECT conv_id, turn, total, stop, before, unnest(words) AS row, unnest(range(len(words))) AS position FROM b)
SELECT conv_id AS dataset_id, CAST(turn AS BIGINT) AS page, position, row FROM x WHERE (stop IS NULL OR turn < stop) AND before + position < total""",
)
def paged_landing(spark, sf):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("dataset_id"), F.col("turn").alias("page"), words.alias("data"))
    totals = pages.groupBy("dataset_id").agg(F.greatest(F.sum(F.size("data")) - 5, F.lit(0)).alias("total"))
    return responses.paged_rows(pages.join(totals, "dataset_id"))


@query(
    "canonical_rows",
    """SELECT CAST(to_json({'event_id': event_id, 'event_type': event_type, 'props': props, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'user_id': user_id, 'value': value}) AS VARCHAR) AS row_json FROM events""",
)
def canonical_rows(spark, sf):
    return digests.canonical_rows(table(spark, sf, "events"))


@query(
    "dataset_digest",
    """WITH j AS (SELECT sha256(CAST(to_json({'event_id': event_id, 'event_type': event_type, 'props': props, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'user_id': user_id, 'value': value}) AS VARCHAR)) AS d FROM events),
q AS (SELECT count(*) AS rows, """
    + ", ".join(f"sum(CAST(('0x' || substr(d, {1 + 16 * i}, 16)) AS UBIGINT)::HUGEINT) AS q{i}" for i in range(4))
    + """ FROM j)
SELECT rows, sha256(concat_ws(':', rows, q0, q1, q2, q3)) AS sha256 FROM q""",
)
def dataset_digest(spark, sf):
    return digests.content_digest(table(spark, sf, "events"))


@query(
    "dataset_hash_tree",
    """WITH j AS (SELECT sha256(CAST(to_json({'event_id': event_id, 'event_type': event_type, 'props': props, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'user_id': user_id, 'value': value}) AS VARCHAR)) AS d FROM events),
q AS (SELECT substr(d, 1, 2) AS prefix, count(*) AS rows, """
    + ", ".join(f"sum(CAST(('0x' || substr(d, {1 + 16 * i}, 16)) AS UBIGINT)::HUGEINT) AS q{i}" for i in range(4))
    + """ FROM j GROUP BY 1),
l2 AS (SELECT prefix, rows, sha256(concat_ws(':', rows, q0, q1, q2, q3)) AS sha256 FROM q),
l1 AS (SELECT substr(prefix, 1, 1) AS prefix, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(prefix || ':' || sha256, ',' ORDER BY prefix)) AS sha256 FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS prefix, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(prefix || ':' || sha256, ',' ORDER BY prefix)) AS sha256 FROM l1)
SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0""",
)
def dataset_hash_tree(spark, sf):
    return digests.hash_tree(table(spark, sf, "events"), 2)


@query(
    "point_checks",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, count(*) AS checked_rows, count(*) FILTER (k < 2) AS blank_point, count(*) FILTER (k IN (5, 6)) AS bad_longitude,
  count(*) FILTER (k IN (6, 7)) AS bad_latitude FROM e GROUP BY 1""",
)
def point_checks(spark, sf):
    from tidemark.schemas import point_rules

    k = F.col("k")
    points = table(spark, sf, "events").withColumn("k", prop()).select(
        "event_type",
        F.when(k == 0, F.lit(" ")).when(k > 1, F.concat(F.lit("p"), k)).alias("point_id"),
        F.when(k == 5, F.lit(180.5)).when(k == 6, F.lit(float("nan"))).otherwise(k * 1.8).alias("longitude"),
        F.when(k == 7, F.lit(-91.0)).when(k != 6, k * 0.9).alias("latitude"),
    )
    return quality.check_rows(points, point_rules(), ["event_type"])


@query(
    "chosen_horizons",
    f"""WITH {S.persistence(S.TYPE, 2)} SELECT series_key, CAST(horizon AS BIGINT) AS horizon, count(*) AS rows, count(prediction) AS predicted
FROM fc WHERE horizon IN (3, 1) GROUP BY 1, 2""",
)
def chosen_horizons(spark, sf):
    """Some horizons, named twice and out of order."""
    chosen = forecast.checked_horizons((3, 1, 3))
    told = forecast.persistence_forecasts(split(spark, sf), chosen)
    return told.groupBy("series_key", "horizon").agg(F.count("*").alias("rows"), F.count("prediction").alias("predicted"))


@query(
    "json_safe_rows",
    """WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k > 0 THEN value / k END AS ratio, CASE WHEN k > 0 THEN value / k END AS nested FROM e""",
)
def json_safe_rows(spark, sf):
    k = prop().cast("double")
    # Division by zero written as infinity, zero over zero as NaN, like a float engine does.
    ratio = F.when(k != 0, F.col("value") / k).otherwise(
        F.when(F.col("value") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    )
    rows = table(spark, sf, "events").select("event_id", ratio.alias("ratio"), F.array(ratio).alias("many"))
    return numbers.non_finite_to_null(rows).select("event_id", "ratio", F.col("many")[0].alias("nested"))
