"""Date and time-of-day helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text date layout of the raw transactions (day/month/year,
# one or two digit day and month) and the time-of-day layout.
RAW_DATE_PATTERN = "d/M/yyyy"
TIME_OF_DAY_REGEX = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})$"

# Weekday and month names in calendar order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]


def parse_raw_date(text: Column) -> Column:
    """Text 'd/m/yyyy' to DATE; impossible or malformed dates give NULL."""
    return F.try_to_date(text, RAW_DATE_PATTERN)


def _name(names: list[str], one_based: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), one_based)


def weekday_name(d: Column) -> Column:
    """Full English weekday name ('Friday'); a lookup, cheaper than a date formatter per row."""
    return _name(WEEKDAYS, F.weekday(d) + 1)


def month_name(d: Column) -> Column:
    """Full English month name ('January')."""
    return _name(MONTHS, F.month(d))


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_index(d: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(d) * 12 + F.month(d)


def year_month_of_index(mi: Column) -> Column:
    """'yyyy-MM' of a ``month_index``."""
    first = F.make_date(F.floor((mi - 1) / 12).cast("int"), ((mi - 1) % 12 + 1).cast("int"), F.lit(1))
    return year_month(first)


def seconds_of_day(text: Column) -> Column:
    """'HH:MM:SS' text to seconds after midnight; NULL when it does not parse."""
    parts = F.split(text, ":")
    h, m, s = (parts.getItem(i).try_cast("int") for i in (0, 1, 2))
    valid = text.rlike(TIME_OF_DAY_REGEX) & (h < 24) & (m < 60) & (s < 60)
    return F.when(valid, h * 3600 + m * 60 + s)


def hms(seconds: Column) -> Column:
    """Seconds after midnight to zero-padded 'HH:MM:SS' text."""
    def two(c: Column) -> Column:
        return F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor((seconds % 3600) / 60)), two(seconds % 60))
