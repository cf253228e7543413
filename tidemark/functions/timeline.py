"""Steps of a regular timeline, written as integer arithmetic on epoch microseconds.

A step is addressed by a long (``step index``) so that lags, positions and block numbers
are plain integer expressions inside whole-stage codegen.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.zones import session_zone

HOUR_US = 3_600_000_000

_UNITS_US = {
    "s": 1_000_000,
    "sec": 1_000_000,
    "min": 60_000_000,
    "h": HOUR_US,
    "d": 24 * HOUR_US,
}


def step_micros(step: str) -> int:
    """Width of a step alias such as ``1h``, ``30min``, ``15s`` or ``1d``."""
    match = re.fullmatch(r"\s*(\d*)\s*([a-zA-Z]+)\s*", step) if isinstance(step, str) else None
    unit = _UNITS_US.get(match.group(2).lower()) if match else None
    count = int(match.group(1) or 1) if match else 0
    if unit is None or count < 1:
        raise ValueError(f"step must be a fixed width such as '1h' or '30min', got {step!r}")
    return count * unit


def zone_shift(spark: SparkSession, step_us: int) -> int:
    """Microseconds that align step edges with the wall clock of the session time zone.

    Zones whose offset changes during the year have no fixed day grid, so they are
    refused unless every offset is a whole number of steps. Moments at which the zone had
    another offset are found by ``aligned_index``.
    """
    zone = session_zone(spark)
    offsets = {
        int(datetime(year, month, 1, tzinfo=zone).utcoffset().total_seconds() * 1_000_000)
        for year in range(2000, 2031)
        for month in (1, 7)
    }
    shifts = {offset % step_us for offset in offsets}
    if len(shifts) > 1:
        raise ValueError(f"time zone {zone} has no fixed grid of this step width; use UTC")
    return shifts.pop()


def aligned_index(spark: SparkSession, ts: Column, step_us: int, shift_us: int) -> Column:
    """``step_index``, failing for a moment whose wall clock is not aligned with the grid."""
    zone = session_zone(spark)
    months = (datetime(year, month, 1, tzinfo=zone) for year in range(1900, 2101) for month in range(1, 13))
    index = step_index(ts, step_us, shift_us)
    if all(int(m.utcoffset().total_seconds() * 1_000_000) % step_us == shift_us for m in months):
        return index
    instant = ts.cast("timestamp")
    minutes = F.date_format(instant, "xxx")
    offset = (F.substring(minutes, 2, 2).cast("int") * 60 + F.substring(minutes, 5, 2).cast("int")) * F.when(
        F.startswith(minutes, F.lit("-")), F.lit(-60_000_000).cast("long")
    ).otherwise(F.lit(60_000_000).cast("long"))
    moved = F.raise_error(F.concat(F.lit(f"{zone} has no grid of this step at "), ts.cast("string"))).cast("long")
    return F.when(ts.isNull() | (F.pmod(offset, F.lit(step_us)) == shift_us), index).otherwise(moved)


def step_index(ts: Column, step_us: int, shift_us: int = 0) -> Column:
    """Index of the left-closed step holding ``ts`` (floor, also before 1970)."""
    us = F.unix_micros(ts.cast("timestamp")) + F.lit(shift_us)
    return F.call_function("div", us - F.pmod(us, F.lit(step_us)), F.lit(step_us))


def step_start(index: Column, step_us: int, shift_us: int = 0) -> Column:
    """Left edge of a step as a timestamp."""
    return F.timestamp_micros(index * F.lit(step_us) - F.lit(shift_us))


def shift_steps(ts: Column, steps: Column | int, step_us: int) -> Column:
    """``ts + steps * step`` for a timestamp column."""
    count = F.lit(steps) if isinstance(steps, int) else steps
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + count * F.lit(step_us))


def floor_div(value: Column, width: int) -> Column:
    """Floor of an integer division that stays a long."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def age_minutes(as_of: Column, anchor: Column) -> Column:
    """Minutes from ``anchor`` to ``as_of``, never negative."""
    gap = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(anchor.cast("timestamp"))
    return F.greatest(F.lit(0.0), gap / F.lit(60_000_000.0))


def freshness(age: Column, budget_minutes: float) -> Column:
    """``stale`` only when the age is strictly above the budget."""
    return F.when(age > F.lit(float(budget_minutes)), F.lit("stale")).otherwise(F.lit("fresh"))


def clock_features(ts: Column) -> dict[str, Column]:
    """Hour of day and month in session local time."""
    local = ts.cast("timestamp")
    return {"hour_of_day": F.hour(local), "month": F.month(local)}
