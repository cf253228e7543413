"""Gap, interval, coverage and contract reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import differs, finite, share
from tidemark.functions.text import OFFSET_PATTERN
from tidemark.operators.blocks import (
    BLOCK_ROWS,
    CORE,
    DEFAULT_BLOCK_STEPS,
    KEYS,
    block_window,
    equal_blocks,
    position_block,
    runs,
    with_margin,
    with_previous,
)

DAY_US = 86_400_000_000


def condition_runs(
    grid: DataFrame,
    flag: Column,
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Runs of grid rows that meet ``flag``: start, end and length in steps."""
    slim = grid.select(
        *keys, "observed_at", position_block(F.col("grid_pos"), block_steps).alias("_at"),
        flag.alias("_wanted"),
    )
    found = runs(slim, keys, "observed_at", F.col("_wanted"), F.col("_at"))
    return found.withColumnsRenamed({"run_start": "start_at", "run_end": "end_at"})


def missing_runs(
    grid: DataFrame, keys: Sequence[str] = KEYS, block_steps: int = DEFAULT_BLOCK_STEPS
) -> DataFrame:
    """Maximal runs of grid rows without a level."""
    return condition_runs(grid, F.col("water_level_m").isNull(), keys, block_steps)


def longest_run(
    grid: DataFrame, keys: Sequence[str] = KEYS, block_steps: int = DEFAULT_BLOCK_STEPS
) -> DataFrame:
    """Longest run of imputed or missing rows per series (0 when there is none)."""
    gap = F.col("water_level_m").isNull() | F.col("is_imputed")
    longest = condition_runs(grid, gap, keys, block_steps).groupBy(*keys).agg(
        F.max("run_length").alias("longest_run")
    )
    series = grid.groupBy(*keys).agg(F.count("*").alias("rows"))
    return series.join(longest, list(keys), "left").select(
        *keys, "rows", F.coalesce("longest_run", F.lit(0)).alias("longest_run")
    )


def top_gaps(gaps: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The n longest runs per series, the earlier one first on equal length.

    Spark turns the rank filter into a per-partition group limit before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("run_length").desc(), F.col("start_at"))
    ranked = gaps.withColumn("gap_rank", F.row_number().over(order))
    return ranked.filter(F.col("gap_rank") <= n)


def gap_statistics(
    grid: DataFrame, keys: Sequence[str] = KEYS, block_steps: int = DEFAULT_BLOCK_STEPS
) -> DataFrame:
    """Bucket counts, repeated stamps, values that are no finite number, and the distribution of gap lengths.

    Runs and the rows between them carry the same counters, so all of it comes from one exchange of the grid.
    Lengths are counted per distinct value first. Distinct lengths of one series are at most
    the square root of twice its rows, which bounds the exact percentile state.
    """
    level = F.col("water_level_m")
    slim = grid.select(*keys, "observed_at", position_block(F.col("grid_pos"), block_steps).alias("_at"), "water_level_m")
    counters = {
        "non_finite": (F.count_if(finite(level).isNull()), F.sum),
        "repeated": (F.count_if(F.col("_again")), F.sum),
    }
    found = runs(slim, keys, "observed_at", level.isNull(), F.col("_at"), counters, rest=True)
    length = F.when(F.col("flagged"), F.col("run_length"))
    lengths = found.groupBy(*keys, length.alias("length")).agg(
        F.count("*").alias("_n"),
        F.sum("run_length").alias("_rows"),
        F.min("run_start").alias("first_at"),
        F.max("run_end").alias("last_at"),
        F.sum("non_finite").alias("_non_finite"),
        F.sum("repeated").alias("_repeated"),
        F.min(F.struct(F.col("run_start").alias("start_at"), F.col("run_end").alias("end_at"))).alias("_first"),
    )
    gap = F.col("length").isNotNull()
    missing = F.coalesce(F.sum(F.when(gap, F.col("_rows"))), F.lit(0))
    quantiles = F.percentile("length", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("_n"))
    return (
        lengths.groupBy(*keys)
        .agg(
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.sum("_rows").alias("expected_buckets"),
            (F.sum("_rows") - missing).alias("observed_buckets"),
            missing.alias("missing_buckets"),
            F.round(share(missing, F.sum("_rows")), 6).alias("missing_rate"),
            F.sum("_repeated").alias("duplicate_timestamps"),
            F.sum("_non_finite").alias("non_finite_values"),
            F.coalesce(F.sum(F.when(gap, F.col("_n"))), F.lit(0)).alias("gap_segments"),
            missing.alias("total_missing_steps"),
            quantiles.alias("_q"),
            F.coalesce(F.max("length"), F.lit(0)).alias("longest_gap"),
            F.max_by("_first", "length").alias("_longest"),
        )
        .select(
            "*",
            *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("gap_p50", "gap_p90", "gap_p99"))],
            F.col("_longest.start_at").alias("longest_gap_start"),
            F.col("_longest.end_at").alias("longest_gap_end"),
        )
        .drop("_q", "_longest")
    )


def stamp_gaps(
    obs: DataFrame, keys: Sequence[str] = KEYS, block_us: int = DAY_US, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Microseconds between consecutive distinct stamps, counted per distinct gap."""
    stamps = obs.select(*keys, "observed_at").distinct()
    placed = equal_blocks(stamps, keys, "observed_at", block_us, block_rows)
    pairs = with_previous(placed, keys, ["observed_at"], F.col("observed_at"), "_before")
    gap = F.unix_micros(F.col("observed_at").cast("timestamp")) - F.unix_micros(
        F.col("_before").cast("timestamp")
    )
    return (
        pairs.filter(F.col("_before").isNotNull())
        .groupBy(*keys, gap.alias("gap_us"))
        .agg(F.count("*").alias("n"))
    )


def sampling_interval(
    obs: DataFrame, keys: Sequence[str] = KEYS, block_us: int = DAY_US, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mode (smallest on ties), median, minimum and maximum gap in seconds.

    ``interval_minutes`` is the dominant interval: the median of the positive gaps. Series
    with fewer than two stamps carry NULLs.
    """
    gaps = stamp_gaps(obs, keys, block_us, block_rows)
    seconds = F.col("gap_us") / F.lit(1_000_000.0)
    stats = gaps.groupBy(*keys).agg(
        F.max_by("gap_us", F.struct(F.col("n"), -F.col("gap_us"))).alias("_mode"),
        F.percentile(seconds, F.lit(0.5), F.col("n")).alias("median_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
    )
    return obs.select(*keys).distinct().join(stats, list(keys), "left").select(
        *keys,
        (F.col("_mode") / F.lit(1_000_000.0)).alias("mode_seconds"),
        "median_seconds",
        "min_seconds",
        "max_seconds",
        (F.col("median_seconds") / F.lit(60.0)).alias("interval_minutes"),
    )


def quality_summary(counts: DataFrame, obs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Audit counters joined with the inferred interval."""
    interval = sampling_interval(obs, keys).select(
        *keys, F.col("interval_minutes").alias("inferred_interval_minutes")
    )
    return counts.join(interval, list(keys), "left")


def day_coverage(obs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Local calendar days with records, missing days, and the widest step between days.

    A widest step of 1 means that no day is missing. Reduced to distinct days before any
    ordered work, so a group is as long as its calendar, not as its data.
    """
    days = obs.select(*keys, F.to_date("observed_at").alias("day")).distinct()
    step = F.date_diff(F.col("day"), F.lag("day").over(Window.partitionBy(*keys).orderBy("day")))
    stats = (
        days.withColumn("_step", step)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("days_with_records"),
            F.min("day").alias("span_start"),
            F.max("day").alias("span_end"),
            F.coalesce(F.max("_step"), F.lit(0)).alias("longest_day_step"),
        )
    )
    span = F.date_diff("span_end", "span_start") + F.lit(1)
    return stats.withColumn("missing_days", span - F.col("days_with_records"))


def missing_days(obs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Calendar days inside each series' span without any record."""
    days = obs.select(*keys, F.to_date("observed_at").alias("day")).distinct()
    span = days.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    return calendar.join(days, [*keys, "day"], "left_anti")


def usable_samples(
    grid: DataFrame,
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Rows where both ``t`` and ``t+h`` have a level, over the whole grid."""
    margined = with_margin(
        grid.select(*keys, "grid_pos", "water_level_m"), "grid_pos", 0, max(horizons), block_steps
    )
    window = block_window(keys, "grid_pos")
    ahead = margined.withColumns(
        {f"_h{h}": F.lead("water_level_m", h).over(window) for h in horizons}
    ).filter(F.col(CORE))
    here = F.col("water_level_m").isNotNull()
    return ahead.groupBy(*keys).agg(
        *[F.count_if(here & F.col(f"_h{h}").isNotNull()).alias(f"usable_h{h}") for h in horizons]
    )


def segment_coverage(
    split: DataFrame,
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Per segment: span, hours, missing and usable rows whose target stays in the segment."""
    slim = split.select(
        *keys, "segment", "grid_pos", "seg_last", "observed_at", "water_level_m", "is_imputed"
    )
    margined = with_margin(slim, "grid_pos", 0, max(horizons), block_steps)
    window = block_window(keys, "grid_pos")
    ahead = margined.withColumns(
        {
            f"_h{h}": F.when(
                F.col("grid_pos") + h <= F.col("seg_last"), F.lead("water_level_m", h).over(window)
            )
            for h in horizons
        }
    ).filter(F.col(CORE))
    here = F.col("water_level_m").isNotNull()
    return (
        ahead.groupBy(*keys, "segment")
        .agg(
            F.min("observed_at").alias("start_at"),
            F.max("observed_at").alias("end_at"),
            F.count("*").alias("hours"),
            F.count_if(~here).alias("missing_buckets"),
            F.count_if(F.col("is_imputed")).alias("imputed_rows"),
            *[F.count_if(here & F.col(f"_h{h}").isNotNull()).alias(f"usable_h{h}") for h in horizons],
        )
        .withColumn("missing_rate", F.round(share(F.col("missing_buckets"), F.col("hours")), 6))
    )


def segment_counters(split: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, imputed, missing and evaluated rows per segment, with the imputed ratio."""
    present = F.col("water_level_m").isNotNull()
    return (
        split.groupBy(*keys, "segment")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("is_imputed")).alias("imputed_rows"),
            F.count_if(~present).alias("missing_rows"),
            F.count_if(present & ~F.col("is_imputed")).alias("evaluated_rows"),
        )
        .withColumn("imputed_ratio", F.round(share(F.col("imputed_rows"), F.col("rows")), 6))
    )


def chunk_quality(
    points: DataFrame,
    chunk: Sequence[str] = ("point_id", "start_date", "end_date"),
    offset: Column | None = None,
    expected_offset: str | None = None,
) -> DataFrame:
    """Per point and date range: volume, missing and repeated hours, alignment, measure differences."""
    precipitation, rain = F.col("precipitation_mm"), F.col("rain_mm")
    differ = differs(precipitation, rain)
    shown = offset if offset is not None else F.date_format("observed_at", "XXX")
    expected = (F.date_diff(F.col("end_date"), F.col("start_date")) + F.lit(1)) * F.lit(24)
    aligned = (F.minute("observed_at") == 0) & (F.second("observed_at") == 0)
    first_level = points.groupBy(*chunk, "observed_at").agg(
        F.count("*").alias("_n"),
        F.count_if(finite(precipitation).isNull()).alias("_p"),
        F.count_if(finite(rain).isNull()).alias("_r"),
        F.bool_and(aligned).alias("_aligned"),
        F.collect_set(shown).alias("_offsets"),
        F.count_if(differ).alias("_d"),
        F.max(F.abs(finite(precipitation) - finite(rain))).alias("_gap"),
    )
    stats = first_level.groupBy(*chunk).agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("_unique"),
        F.sum("_p").alias("non_finite_precipitation"),
        F.sum("_r").alias("non_finite_rain"),
        F.bool_and("_aligned").alias("hour_aligned"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_offsets")))).alias("utc_offsets"),
        F.sum("_d").alias("diff_rows"),
        F.max("_gap").alias("max_abs_diff"),
        F.min(F.when(F.col("_d") > 0, F.col("observed_at"))).alias("first_diff_at"),
        F.min("observed_at").alias("start_timestamp"),
        F.max("observed_at").alias("end_timestamp"),
    )
    result = (
        stats.withColumn("expected_hours", expected.cast("long"))
        .withColumn("missing_hours", F.greatest(F.col("expected_hours") - F.col("_unique"), F.lit(0)))
        .withColumn("missing_rate", F.round(share(F.col("missing_hours"), F.col("expected_hours")), 6))
        .withColumn("duplicate_timestamps", F.col("rows") - F.col("_unique"))
        .drop("_unique")
    )
    if expected_offset is not None:
        result = result.withColumn(
            "offset_as_expected", F.col("utc_offsets") == F.array(F.lit(expected_offset))
        )
    return result


def chunk_rollup(chunks: DataFrame, point: str = "point_id") -> DataFrame:
    """Chunk counters per point plus one total row (NULL point)."""
    return chunks.rollup(point).agg(
        F.count("*").alias("chunks"),
        *[
            F.sum(c).alias(c)
            for c in ("rows", "expected_hours", "missing_hours", "duplicate_timestamps", "diff_rows")
        ],
        F.bool_and("hour_aligned").alias("all_hour_aligned"),
    )


def year_chunks(points: DataFrame, start: date, end: date) -> DataFrame:
    """One planned chunk per point and calendar year of a closed date range."""
    if end < start:
        raise ValueError(f"end must not be earlier than start: {start} > {end}")
    year = F.explode(F.sequence(F.lit(start.year), F.lit(end.year)))
    return points.withColumn("_year", year).select(
        *points.columns,
        F.greatest(F.make_date("_year", F.lit(1), F.lit(1)), F.lit(start)).alias("start_date"),
        F.least(F.make_date("_year", F.lit(12), F.lit(31)), F.lit(end)).alias("end_date"),
    )


def chunk_state(
    planned: DataFrame,
    loaded: DataFrame,
    on: Sequence[str] = ("point_id", "start_date", "end_date"),
) -> DataFrame:
    """Resume decision per planned chunk from loaded rows and the recorded receipt.

    ``loaded`` has ``rows`` and a nullable ``receipt_rows``. A chunk is complete only when it
    has rows, as many as expected, and the receipt does not disagree.
    """
    expected = (F.date_diff(F.col("end_date"), F.col("start_date")) + F.lit(1)) * F.lit(24)
    joined = planned.join(loaded, list(on), "left").withColumn("expected_hours", expected.cast("long"))
    state = (
        F.when(F.col("rows").isNull(), F.lit("missing"))
        .when(F.col("rows") <= 0, F.lit("empty"))
        .when(F.col("rows") != F.col("expected_hours"), F.lit("incomplete"))
        .when(
            F.col("receipt_rows").isNotNull() & (F.col("receipt_rows") != F.col("rows")),
            F.lit("stale_receipt"),
        )
        .otherwise(F.lit("complete"))
    )
    return joined.withColumn("state", state)


def order_violations(
    rows: DataFrame, keys: Sequence[str] = KEYS, block_us: int = DAY_US
) -> DataFrame:
    """Duplicate stamps, and rows (by input position) whose stamp does not increase."""
    per_stamp = rows.groupBy(*keys, "observed_at").agg(F.count("*").alias("_n"))
    repeated = per_stamp.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicate_stamps"))
    if "row_position" not in rows.columns:
        return repeated
    slim = rows.select(*keys, "row_position", "observed_at")
    pairs = with_previous(
        slim, keys, ["row_position"], F.col("observed_at"), "_before",
        position_block(F.col("row_position"), 1 << 16),
    )
    unordered = pairs.groupBy(*keys).agg(
        F.count_if(F.col("observed_at") <= F.col("_before")).alias("order_violations")
    )
    return repeated.join(unordered, list(keys))


def check_rows(rows: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Number of rows breaking each named rule (a rule is true for a bad row)."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("checked_rows"),
        *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()],
    )


def require_clean(rows: DataFrame, rules: Mapping[str, Column], what: str) -> DataFrame:
    """Fail when any rule is broken; one small aggregate is read."""
    counts = check_rows(rows, rules).first()
    broken = {name: counts[name] for name in rules if counts[name]}
    if broken:
        raise ValueError(f"{what} breaks its contract: {broken}")
    return rows


def no_rows_expected(rows: DataFrame, what: str, limit: int = 10) -> None:
    """Fail when ``rows`` (for example an anti join) is not empty, naming a few of them."""
    found = rows.limit(limit).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def with_axes(df: DataFrame, **axes: Sequence[object]) -> DataFrame:
    """Every row of ``df`` for each combination of a few fixed axis values."""
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def expected_grid(spark: SparkSession, **axes: Sequence[object]) -> DataFrame:
    """All combinations of a few named axes (a fixed, tiny table)."""
    return with_axes(spark.range(1).select(), **axes)


def offset_summary(rows: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Offsets named by time texts: rows, distinct offsets (more than one must be refused)
    and the first instant after conversion."""
    shown = F.regexp_extract(F.col(column), OFFSET_PATTERN, 1)
    per_offset = rows.groupBy(*keys, shown.alias("_offset")).agg(
        F.count("*").alias("_n"), F.min(F.col(column).try_cast("timestamp")).alias("_first")
    )
    return per_offset.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("offsets"),
        F.min("_first").alias("first_at"),
    )


def require_uniform_offset(rows: DataFrame, column: str) -> DataFrame:
    """Refuse naive or mixed-offset stamps, then convert to instants."""
    shown = F.nullif(F.regexp_extract(F.col(column), OFFSET_PATTERN, 1), F.lit(""))
    found = [r[0] for r in rows.select(shown.alias("o")).distinct().take(2)]
    if len(found) > 1 or found == [None]:
        raise ValueError(f"{column} must carry one UTC offset, found {found}")
    return rows.withColumn(column, F.col(column).try_cast("timestamp"))
