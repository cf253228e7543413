"""The session time zone on the driver side, for decisions made while a plan is built."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone, tzinfo
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

# The offset forms Spark accepts besides region names.
_OFFSET = r"(?:UTC|GMT|UT)?([+-])(\d{1,2})(?::?(\d{2}))?"


def session_zone(spark: SparkSession) -> tzinfo:
    """Region zones such as ``Asia/Shanghai`` and fixed offsets such as ``+08:00``."""
    name = spark.conf.get("spark.sql.session.timeZone")
    fixed = re.fullmatch(_OFFSET, name)
    if fixed:
        sign, hours, minutes = fixed.groups()
        size = timedelta(hours=int(hours), minutes=int(minutes or 0))
        return timezone(size if sign == "+" else -size)
    return ZoneInfo("UTC" if name in ("Z", "UT") else name)


@lru_cache
def changed_spans(zone: tzinfo, first: int = 1900, last: int = 2100) -> tuple[tuple[int, int], ...]:
    """The wall times that offset changes skip or repeat, as sorted ``(first, end)`` seconds since 1970 of the wall clock.

    A change of offset at an instant skips or repeats the wall times between the instant under the smaller and
    under the larger offset. Changes are found a week apart or more and narrowed down to the second.
    """
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(at: int) -> int:
        return int((epoch + timedelta(seconds=at)).astimezone(zone).utcoffset().total_seconds())

    begin, end = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for y in (first, last))
    spans = []
    for low in range(begin, end, 7 * 86_400):
        high = low + 7 * 86_400
        before, after = offset(low), offset(high)
        if before == after:
            continue
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if offset(middle) == before else (low, middle)
        spans.append((high + min(before, after), high + max(before, after)))
    return tuple(spans)
