"""Raw text to typed values. Unusable text becomes NULL, it never raises in a task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.zones import changed_spans, session_zone

# The accepted forms of a decimal number and of a local offset.
NUMBER_PATTERN = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
NOT_A_NUMBER_PATTERN = r"(?i)^[+-]?nan$"
OFFSET_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"

# Accepted spellings of a boolean.
TRUE_TEXT = ("true", "1", "1.0")
FALSE_TEXT = ("false", "0", "0.0")


# The white space of Unicode, for patterns.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trimmed(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c.cast("string"), f"^{SPACE}+|{SPACE}+$", "")


def optional_text(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(trimmed(c), F.lit(""))


def record_id(c: Column, *, numeric_source: bool = False) -> Column:
    """Record id as text; an integral float loses its ``.0`` only for numeric sources."""
    text = optional_text(c)
    if not numeric_source:
        return text
    # Large doubles are printed with an exponent.
    printed = F.rlike(text, F.lit(r"^-?\d+(\.\d+)?[eE]\+?\d+$"))
    whole = text.try_cast("double").try_cast("decimal(38,0)")
    spelt = F.when(printed & (whole.cast("double") == text.try_cast("double")), whole.cast("string")).otherwise(text)
    plain = F.regexp_replace(spelt, r"^(-?\d+)\.0$", "$1")
    return F.when(F.lower(plain) == "nan", F.lit(None).cast("string")).otherwise(plain)


def has_offset(text: Column) -> Column:
    """True when the text names its own UTC offset."""
    clock = F.rlike(text, F.lit(r"[T ]\d{2}"))
    return clock & F.rlike(text, F.lit(OFFSET_PATTERN))


# Month names by number.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# The form that is parsed as it stands, and a clock in any of its spellings.
PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?)?$"
CLOCK = (
    r"(?i)^(?:\s*T|\s*,?\s+)(\d{1,2})(?::?(\d{2}))?(?::?(\d{2})(?:[.,](\d{1,9}))?)?"
    r"(?:\s*([ap])\.?m\.?)?(?:\s*(z|utc|gmt|[+-]\d{2}(?::?\d{2})?))?$"
)

# Spellings of a date with the groups of its year, month and day; the last group is the rest. The first that fits holds.
DATES = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(|[T ,].*)$", 1, 2, 3),
    (r"^(\d{4})(\d{2})(\d{2})(|[T ].*)$", 1, 2, 3),
    (r"^(1[3-9]|[23]\d)[-/.](\d{1,2})[-/.](\d{4})(|[T ,].*)$", 3, 2, 1),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(|[T ,].*)$", 3, 1, 2),
    (r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[-\s]([a-z]{3,9})\.?[-,\s]+(\d{4})(|[T ,].*)$", 3, 2, 1),
    (r"(?i)^(?:[a-z]{3,9},?\s+)?([a-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(|[T ,].*)$", 3, 1, 2),
)
WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(|[T ].*)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _month(text: Column) -> Column:
    """Month number of digits or of a name; NULL for other words."""
    named = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(text, 1, 3))), F.lit(0))
    return F.coalesce(text.try_cast("long"), named)


def _date_and_rest(text: Column) -> Column:
    """``(date, rest)`` by the first spelling that fits, NULL without one."""
    week = lambda i: F.regexp_extract(text, WEEK, i)
    fourth = F.try_to_date(F.concat(week(1), F.lit("-01-04")))
    days = (week(2).try_cast("int") - 1) * 7 + F.coalesce(week(3).try_cast("int"), F.lit(1)) - 1
    by_week = F.date_add(F.date_sub(fourth, F.weekday(fourth)), days).cast("string")
    out = F.when(F.rlike(text, F.lit(WEEK)), F.struct(by_week.alias("date"), week(4).alias("rest")))
    for pattern, year, month, day in DATES:
        part = lambda i, pattern=pattern: F.regexp_extract(text, pattern, i)
        date = F.concat(part(year), F.lit("-"), F.lpad(_month(part(month)).cast("string"), 2, "0"), F.lit("-"), F.lpad(part(day), 2, "0"))
        out = out.when(F.rlike(text, F.lit(pattern)), F.struct(date.alias("date"), part(4).alias("rest")))
    return out


def _clock(rest: Column) -> Column:
    """``HH:mm:ss`` with fraction and offset from any of its spellings; midnight without one, NULL if unreadable."""
    part = lambda i: F.regexp_extract(rest, CLOCK, i)
    hour, half, offset = part(1).try_cast("int"), F.lower(part(5)), F.upper(part(6))
    on_dial = F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    shown = F.lpad(F.when(half == "", hour).otherwise(on_dial).cast("string"), 2, "0")
    fraction = F.when(part(4) != "", F.concat(F.lit("."), F.substring(part(4), 1, 6))).otherwise("")
    named = F.when(offset.isin("Z", "UTC", "GMT"), F.lit("Z")).when(offset == "", F.lit(""))
    spelt = F.concat(F.substring(offset, 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(offset, 4, 3), ":", ""), 2, "0"))
    two = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
    clock = F.concat(F.lit(" "), shown, F.lit(":"), two(2), F.lit(":"), two(3), fraction, F.coalesce(named, spelt))
    return F.when(F.trim(rest) == "", F.lit(" 00:00:00")).when(F.rlike(rest, F.lit(CLOCK)), clock)


def iso_text(text: Column) -> Column:
    """Accepted spellings of a time in the ISO form; NULL without a date.

    The plain form is taken as it stands. Else the text is trimmed and its date is read by an ordered table of spellings:
    dashes, slashes, dots or nothing between the parts, month first when the year comes last (day first where
    the month would be above 12), names of months with or without a weekday, ISO weeks. The clock may lack
    colons, minutes or seconds, and may carry AM or PM and an offset of any length.
    """

    def read(trim: Column) -> Column:
        return let(_date_and_rest(trim), lambda p: F.concat(p["date"], let(p["rest"], _clock)))

    return F.when(F.rlike(text, F.lit(PLAIN)), text).otherwise(let(optional_text(text), read))


def refused_wall(wall: Column, spans: Sequence[tuple[int, int]]) -> Column:
    """Whether a zone-less time lies in one of the sorted ``(first, end)`` spans of wall seconds, by binary search."""
    if not spans:
        return F.lit(False)
    seconds = F.unix_date(F.to_date(wall)).cast("long") * 86_400 + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)
    firsts = F.array(*[F.lit(a).cast("long") for a, _ in spans])
    ends = F.array(*[F.lit(b).cast("long") for _, b in spans])
    steps = F.array(*[F.lit(1 << k) for k in range(len(spans).bit_length() - 1, -1, -1)])

    def look(at: Column) -> Column:
        last = F.aggregate(steps, F.lit(-1), lambda i, step: F.when(F.get(firsts, i + step) <= at, i + step).otherwise(i))
        return (last >= 0) & (at < F.get(ends, last))

    return F.coalesce(let(seconds, lambda at: F.coalesce(look(at), F.lit(False))), F.lit(False))


def with_timestamp(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add the instant of a text: its ISO form, a date alone means midnight, unusable is NULL.

    A naive wall time that a clock change of the session zone skips or repeats is refused,
    because no offset may be guessed. The zone's skipped and repeated spans are a short sorted table.
    """
    stepped = df.withColumn("_text", iso_text(F.col(source).cast("string")))
    instant = F.try_to_timestamp("_text")
    spans = changed_spans(session_zone(df.sparkSession))
    if spans:
        wall = F.col("_text").try_cast("timestamp_ntz")
        instant = F.when(has_offset(F.col("_text")) | ~refused_wall(wall, spans), instant)
    return stepped.withColumn(out, instant).drop("_text")


def level_state(c: Column) -> Column:
    """``ok``, ``missing`` (blank or NaN) or ``invalid`` (text, infinity)."""
    text = optional_text(c)
    number = level_value(c)
    return (
        F.when(text.isNull() | F.rlike(text, F.lit(NOT_A_NUMBER_PATTERN)), F.lit("missing"))
        .when(number.isNull(), F.lit("invalid"))
        .otherwise(F.lit("ok"))
    )


def level_value(c: Column) -> Column:
    """Finite double of a text, otherwise NULL."""
    text = optional_text(c)
    number = F.regexp_replace(text, "_", "").try_cast("double")
    plain = F.rlike(text, F.lit(NUMBER_PATTERN)) & (F.abs(number) < F.lit(float("inf")))
    return F.when(plain, number)


def boolean_text(c: Column) -> Column:
    """Boolean of its accepted spellings, NULL for anything else."""
    text = F.lower(trimmed(c))
    return F.when(text.isin(*TRUE_TEXT), F.lit(True)).when(text.isin(*FALSE_TEXT), F.lit(False))


def date_only(c: Column) -> Column:
    """True for a non-blank stamp without a clock part."""
    text = trimmed(F.coalesce(c.cast("string"), F.lit("")))
    return (text != "") & ~F.contains(text, F.lit(" "))
