"""Publish dates as epoch seconds, and the labels shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsluice.functions.clean import collapse, let, strip
from jobsluice.settings import DEFAULT, Settings

DAY = 86_400
EARLIEST = 946_684_800  # 2000-01-01
LATEST = 4_102_444_800  # 2100-01-01
MILLIS_ABOVE = 1e11


def at(as_of: int | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(int(as_of)).cast("bigint")


def _epoch(text: Column) -> Column:
    """Epoch seconds of an ISO text with an offset; null when it does not read."""
    return F.unix_seconds(F.try_to_timestamp(text))


def _iso(text: Column) -> Column:
    """ISO date or date-time; without an offset it is UTC."""
    def read(full: Column) -> Column:
        zoned = F.when(full.rlike(r":\d{2}.*(?:Z|[+\-]\d{2}:\d{2})$"), full).otherwise(
            F.when(F.length(full) > 10, F.concat(full, F.lit("Z"))))
        return F.coalesce(
            _epoch(zoned),
            _epoch(F.concat(F.substring(text, 1, 19), F.lit("Z"))),
            _epoch(F.concat(F.substring(text, 1, 10), F.lit("T00:00:00Z"))))

    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), let(
        F.regexp_replace(text, r"([+\-]\d{2})(\d{2})$", "$1:$2"), read))


def _prose(low: Column, as_of: int | Column) -> Column:
    """``posted 3+ days ago`` in lower case; null when no age is named."""
    days = F.regexp_extract(low, r"(\d+)\+?\s*day", 1)
    age = (F.when(low.contains("today") | low.contains("just posted"), 0)
           .when(low.contains("yesterday"), 1)
           .when(days != "", F.coalesce(days.try_cast("bigint"), F.lit(-1))))
    return let(age.cast("bigint"), lambda n: F.when(n.isNotNull(), F.coalesce(
        F.when(n >= 0, at(as_of) - n * DAY), F.lit(0).cast("bigint"))))


def parse_date(value: Column, as_of: int | Column) -> Column:
    """Seconds, milliseconds, prose ages and ISO text; 0 when nothing reads."""
    def bounded(number: Column) -> Column:
        seconds = F.when(number > MILLIS_ABOVE, number / 1000).otherwise(number)
        return F.when((seconds > EARLIEST) & (seconds < LATEST), seconds.cast("bigint"))

    def read(text: Column) -> Column:
        # An ISO text names no age; it is told first, as most dates are one.
        return (
            F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:T[\d:.+\-]*Z?)?$"), _iso(text))
            .when(text.rlike(r"^-?\d+(?:\.\d+)?(?:[Ee]\+?\d+)?$"),
                  let(text.try_cast("double"), bounded))
            .when(text != "", F.coalesce(let(F.lower(text), lambda low: _prose(low, as_of)),
                                         _iso(text))))

    return F.coalesce(let(strip(value), read), F.lit(0).cast("bigint"))


def first_date(*values: Column, as_of: int | Column) -> Column:
    """The first value that reads as a date, else 0."""
    parsed = [let(parse_date(v, as_of), lambda seconds: F.when(seconds != 0, seconds))
              for v in values]
    return F.coalesce(*parsed, F.lit(0).cast("bigint"))


def parse_table_date(cell: Column, as_of: int | Column) -> Column:
    """A tracker table's date cell: ISO, ``3d``, ``2w``, ``1mo``, ``Aug 21``."""
    text = strip(cell)
    age = r"(?i)^(\d+)\s*([dhwmo])"
    count = F.regexp_extract(text, age, 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, age, 2))
    scale = (F.when(unit == "h", 3600).when(unit == "w", 7 * DAY)
             .when(unit == "m", 30 * DAY).otherwise(DAY))

    month_day = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})"
    year = F.year(F.to_utc_timestamp(F.timestamp_seconds(at(as_of)), F.current_timezone()))

    def in_year(y: Column) -> Column:
        day = F.concat_ws(" ", y.cast("string"), F.regexp_extract(text, month_day, 1),
                          F.regexp_extract(text, month_day, 2))
        return F.unix_date(F.try_to_date(day, "yyyy MMM d")).cast("bigint") * DAY

    this_year = in_year(year)
    dated = F.when(this_year - at(as_of) >= 32 * DAY, in_year(year - 1)).otherwise(this_year)
    parsed = F.nullif(parse_date(text, as_of), F.lit(0))
    return F.coalesce(
        parsed,
        F.when(text.rlike(age), at(as_of) - count * scale),
        F.when(text.rlike(month_day), dated),
        F.lit(0).cast("bigint"))


def _formatted(text: Column, *formats: str) -> Column:
    zoned = F.concat(collapse(text), F.lit(" Z"))
    parsed = [F.unix_seconds(F.try_to_timestamp(zoned, F.lit(f"{fmt} XXX"))) for fmt in formats]
    return F.coalesce(*parsed, F.lit(0).cast("bigint"))


def long_date(text: Column) -> Column:
    """``September  9, 2026``"""
    return _formatted(text, "MMMM d, yyyy")


def clock_date(text: Column) -> Column:
    """``9/21/2026 4:05 PM``"""
    return _formatted(text, "M/d/yyyy h:mm a")


def short_date(text: Column) -> Column:
    """``Sep. 9, 2026`` or ``September 9, 2026``"""
    return _formatted(F.regexp_replace(text, r"\.", ""), "MMM d, yyyy", "MMMM d, yyyy")


def _local_day(ts: Column, zone: str) -> Column:
    utc = F.to_utc_timestamp(F.timestamp_seconds(ts), F.current_timezone())
    return F.to_date(F.from_utc_timestamp(utc, zone))


def days_ago(ts: Column, as_of: int | Column, cfg: Settings = DEFAULT) -> Column:
    """Whole calendar days between a time and now, where the reader lives."""
    return F.greatest(
        F.datediff(_local_day(at(as_of), cfg.timezone),
                   _local_day(F.coalesce(ts, F.lit(0)), cfg.timezone)), F.lit(0))


def day_label(ts: Column, as_of: int | Column, cfg: Settings = DEFAULT) -> Column:
    days = days_ago(ts, as_of, cfg)
    readable = F.coalesce(ts, F.lit(0)).between(-62_135_596_800, 253_402_300_799)
    return F.when(~readable, "unknown").otherwise(
        F.when(days == 0, "Today").when(days == 1, "Yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago"))))


def when_label(posted_at: Column, seeded: Column, shown_at: Column, as_of: int | Column,
               cfg: Settings = DEFAULT) -> Column:
    """Age as shown: undated seeds have none, undated rows say when they were found."""
    undated = F.coalesce(posted_at, F.lit(0)) == 0
    label = day_label(shown_at, as_of, cfg)
    found = F.concat(F.lit("found "), F.lower(F.substring(label, 1, 1)),
                     F.substring(label, 2, 100))
    return F.when(undated & seeded, "date unknown").when(undated, found).otherwise(label)


def is_today(posted_at: Column, seeded: Column, shown_at: Column, as_of: int | Column,
             cfg: Settings = DEFAULT) -> Column:
    undated_seed = (F.coalesce(posted_at, F.lit(0)) == 0) & seeded
    return ~undated_seed & (days_ago(shown_at, as_of, cfg) == 0)


def window_label(hours: Column) -> Column:
    return F.when(hours >= 48, F.concat(F.floor(hours / 24).cast("string"), F.lit(" days"))) \
        .otherwise(F.concat(hours.cast("string"), F.lit(" hours")))


def windows_label(hours: Column, strict_hours: Column) -> Column:
    window, strict = window_label(hours), window_label(F.greatest(hours, strict_hours))
    return F.when(window == strict, F.concat(F.lit("last "), window)).otherwise(
        F.concat(F.lit("AI/ML last "), strict, F.lit(", others last "), window))


def is_fresh(posted_at: Column, as_of: int | Column, cfg: Settings = DEFAULT) -> Column:
    """Recent enough to alert on; an unknown date counts as fresh."""
    since = at(as_of) - cfg.max_age_hours * 3600
    return (F.coalesce(posted_at, F.lit(0)) == 0) | (posted_at >= since)
