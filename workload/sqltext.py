"""Building blocks of the checking SQL (run by DuckDB on the same tables)."""

from __future__ import annotations

TYPE = "event_type"
USER = "CAST(user_id AS VARCHAR)"


def obs(key: str = TYPE) -> str:
    return (
        f"obs AS (SELECT {key} AS series_key, CAST(event_id AS VARCHAR) AS id, ts AS tt, "
        "value AS level FROM events)"
    )


def grid(key: str = TYPE, fill: int = 2) -> str:
    w = "(PARTITION BY series_key ORDER BY pos ROWS BETWEEN"
    before = f"OVER {w} UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"OVER {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""{obs(key)},
bucket AS (SELECT series_key, date_trunc('hour', tt) AS tt, arg_max(level, tt) AS level,
  arg_max(id, tt) AS id FROM obs GROUP BY 1, 2),
span AS (SELECT series_key, min(tt) AS a, max(tt) AS b FROM bucket GROUP BY 1),
steps AS (SELECT series_key, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS tt FROM span),
base AS (SELECT s.series_key, s.tt,
  row_number() OVER (PARTITION BY s.series_key ORDER BY s.tt) - 1 AS pos,
  count(*) OVER (PARTITION BY s.series_key) AS n, b.level AS raw, b.id
  FROM steps s LEFT JOIN bucket b ON s.series_key = b.series_key AND s.tt = b.tt),
near AS (SELECT *,
  last_value(raw IGNORE NULLS) {before} AS lv,
  last_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) {before} AS lp,
  first_value(raw IGNORE NULLS) {after} AS rv,
  first_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) {after} AS rp FROM base),
grid AS (SELECT series_key, tt, pos, n, id, raw,
  CASE WHEN raw IS NULL THEN rp - lp - 1 END AS gap,
  COALESCE(raw IS NULL AND rp - lp - 1 <= {fill}, FALSE) AS imp,
  COALESCE(raw, CASE WHEN rp - lp - 1 <= {fill}
    THEN lv + (rv - lv) * (pos - lp) / (rp - lp) END) AS level FROM near)"""


def split(key: str = TYPE, fill: int = 2) -> str:
    return f"""{grid(key, fill)},
cut AS (SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS c1,
  CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS c2 FROM grid),
split AS (SELECT *, CASE WHEN n < 7 OR c1 <= 0 OR c2 <= 0 OR n - c1 - c2 <= 0 THEN NULL
  WHEN pos < c1 THEN 'train' WHEN pos < c1 + c2 THEN 'validation' ELSE 'test' END AS segment FROM cut)"""


RAIN_POINTS = """pts0 AS (SELECT ts, event_type, CAST(value AS DECIMAL(18,4)) AS v,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
points AS (SELECT date_trunc('hour', ts) AS tt, event_type AS point_id,
  CAST(sum(v) AS DOUBLE) AS precipitation_mm,
  CAST(sum(CASE WHEN k >= 10 THEN v ELSE 0 END) AS DOUBLE) AS rain_mm FROM pts0 GROUP BY 1, 2)"""

RAIN = f"""{RAIN_POINTS},
rspan AS (SELECT min(tt) AS a, max(tt) AS b FROM points),
rhours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS tt FROM rspan),
rain AS (SELECT h.tt, avg(p.rain_mm) AS rain, count(p.rain_mm) AS points
  FROM rhours h LEFT JOIN points p ON h.tt = p.tt GROUP BY 1)"""


def features(key: str = TYPE, fill: int = 2) -> str:
    """The whole feature matrix as a CTE named ``features``."""
    w = "(PARTITION BY series_key, segment ORDER BY pos)"
    cols = [f"lag(level, {k}) OVER {w} AS water_level_lag_{k}" for k in (1, 2, 3, 6, 12, 24)]
    cols += [f"lag(rain, {k}) OVER {w} AS rain_lag_{k}" for k in (0, 1, 2, 3, 6, 12)]
    for n in (1, 3, 6, 12, 24):
        f = f"OVER (PARTITION BY series_key, segment ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"CASE WHEN count(rain) {f} = {n} THEN sum(rain) {f} END AS rain_cum_{n}")
    for h in (1, 3, 6):
        cols.append(f"lead(level, {h}) OVER {w} AS target_h{h}")
        cols.append(
            f"COALESCE(level IS NOT NULL AND lead(level, {h}) OVER {w} IS NOT NULL "
            f"AND NOT lead(imp, {h}) OVER {w}, FALSE) AS usable_h{h}"
        )
    return f"""{split(key, fill)},
{RAIN},
joined AS (SELECT s.*, r.rain, r.points FROM split s LEFT JOIN rain r ON s.tt = r.tt),
features AS (SELECT series_key, tt AS observed_at, segment, pos, level AS water_level_t,
  {", ".join(cols)},
  CAST(hour(tt) AS BIGINT) AS hour_of_day, CAST(month(tt) AS BIGINT) AS month,
  imp AS is_imputed_t, id AS source_record_id_t, points AS rain_point_count FROM joined)"""


def persistence(key: str = TYPE, fill: int = 2) -> str:
    """Long persistence forecasts as ``fc`` and the scored rows as ``scored``."""
    parts = " UNION ALL ".join(
        f"SELECT series_key, 'persistence' AS model, {h} AS horizon, segment, "
        f"tt - INTERVAL {h} HOUR AS anchor, tt AS target, level AS observed, "
        f"lag(level, {h}) OVER (PARTITION BY series_key ORDER BY pos) AS prediction, imp FROM split"
        for h in (1, 3, 6)
    )
    return f"""{split(key, fill)},
fc AS ({parts}),
scored AS (SELECT * FROM fc WHERE observed IS NOT NULL AND prediction IS NOT NULL AND NOT imp)"""


def scores(source: str, by: str) -> str:
    """Score columns over the valid rows of ``source`` grouped by ``by``."""
    return f"""SELECT {by}, count(*) AS sample_count,
  avg(abs(prediction - observed)) AS mae,
  sqrt(sum((prediction - observed) * (prediction - observed)) / count(*)) AS rmse,
  CASE WHEN var_pop(observed) > 0 THEN 1 - sum((prediction - observed) * (prediction - observed))
    / (count(*) * var_pop(observed)) END AS nse,
  abs(max(observed) - max(prediction)) AS peak_absolute_error
  FROM {source} GROUP BY ALL"""


def thresholds(q: float = 0.9) -> str:
    """Needs ``split``."""
    return f"""th AS (SELECT series_key, quantile_cont(level, {q}) AS threshold, count(*) AS fit_rows
  FROM split WHERE segment = 'train' AND NOT imp AND level IS NOT NULL GROUP BY 1)"""


def runs(source: str, flag: str, order: str, keys: str, extra: str = "") -> str:
    """Islands of ``flag`` over ``source``: start, end, points."""
    tail = f", {extra}" if extra else ""
    return f"""SELECT {keys}, min({order}) AS run_start, max({order}) AS run_end, count(*) AS run_length{tail}
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order})
    - row_number() OVER (PARTITION BY {keys}, {flag} ORDER BY {order}) AS island FROM {source}) z
  WHERE {flag} GROUP BY {keys}, island"""


RAW = """raw0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
raw AS (SELECT event_type AS series_key,
  CASE WHEN k < 3 THEN '  ' WHEN k = 3 THEN chr(9) || chr(12288) WHEN k = 12 THEN chr(9) || user_id || '-12' || chr(12288) ELSE ' ' || user_id || '-' || k END AS z_id,
  CASE WHEN k = 7 THEN '2024-01-01 25:00:00' WHEN k = 8 THEN strftime(ts, '%Y-%m-%d')
    WHEN k = 9 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN k = 10 THEN strftime(ts, '%Y%m%d %H%M%S') WHEN k = 11 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00'
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time_d,
  CASE WHEN k = 20 THEN '' WHEN k = 21 THEN 'n/a' WHEN k = 22 THEN 'NaN' WHEN k = 23 THEN 'Infinity'
    ELSE CAST(value AS VARCHAR) END AS up_water_level, event_id AS pos, k, ts FROM raw0),
typed AS (SELECT * EXCLUDE (k, ts), NULLIF(regexp_replace(z_id, '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g'), '') AS id,
  CASE WHEN k IN (9, 10, 11) THEN date_trunc('second', ts) ELSE TRY_CAST(time_d AS TIMESTAMP) END AS tt,
  TRY_CAST(NULLIF(trim(up_water_level), '') AS DOUBLE) AS num FROM raw),
judged AS (SELECT *, CASE WHEN id IS NULL OR tt IS NULL THEN 'invalid_timestamp'
  WHEN trim(up_water_level) = '' OR isnan(num) THEN 'missing_level'
  WHEN num IS NULL OR isinf(num) THEN 'invalid_level' END AS reason FROM typed),
kept AS (SELECT series_key, id, arg_max(tt, pos) AS tt, arg_max(num, pos) AS num, count(*) AS c
  FROM judged WHERE reason IS NULL GROUP BY 1, 2)"""
