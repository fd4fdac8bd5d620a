"""Time expressions that behave the same in Spark and in ANSI engines.

All trip times are TIMESTAMP_NTZ (wall clock, no zone), so none of these
depend on the session time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from 'YYYY-MM-DD[ HH:MM:SS]', a date or a datetime.

    Constant-folded by Catalyst, so comparisons against it reach the Parquet
    scan as pushed filters.
    """
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def duration_seconds(pickup="pickup_time", dropoff="dropoff_time") -> Column:
    """Fractional seconds from pickup to drop-off (negative when reversed).

    NTZ minus NTZ is a day-time interval of wall-clock time, independent of
    the session time zone (a daylight-saving gap does not change it); the
    interval casts exactly to seconds with microsecond fraction.
    """
    return (_col(dropoff) - _col(pickup)).cast("decimal(18,6)").cast("double")


def day_of_week(c="pickup_time") -> Column:
    """Day of week with 0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(_col(c)) - 1


def in_range(c, start, end) -> Column:
    """Half-open range start <= c < end on a timestamp column."""
    c = _col(c)
    return (c >= ntz(start)) & (c < ntz(end))


def year_range(c, year: int) -> Column:
    """c falls in calendar year `year`, as a range so both bounds push down."""
    return in_range(c, _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1))


def years_range(c, first: int, last: int) -> Column:
    """c falls in years first..last inclusive."""
    return in_range(c, _dt.date(first, 1, 1), _dt.date(last + 1, 1, 1))


def month_range(c, year: int, first_month: int, last_month: int) -> Column:
    """c falls in months first..last (inclusive) of `year`."""
    end = (_dt.date(year + 1, 1, 1) if last_month == 12
           else _dt.date(year, last_month + 1, 1))
    return in_range(c, _dt.date(year, first_month, 1), end)


def quarter_range(c, year: int, quarter: int) -> Column:
    """c falls in quarter `quarter` (1-4) of `year`."""
    first = (quarter - 1) * 3 + 1
    return month_range(c, year, first, quarter * 3)


def since(c, start) -> Column:
    """c >= start, no upper bound."""
    return _col(c) >= ntz(start)


def event_time(c="pickup_time") -> Column:
    """The NTZ wall clock as a TIMESTAMP instant with the same epoch value.

    Watermarks need TIMESTAMP; this mapping is fixed (as if the wall clock
    were UTC), so windows align with wall-clock days in any session zone.
    """
    since_epoch = (_col(c) - ntz("1970-01-01")).cast("decimal(18,6)")
    return F.timestamp_seconds(since_epoch)


def epoch_date(instant: Column) -> Column:
    """Calendar date of an ``event_time`` instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / F.lit(86_400_000_000)).cast("int"))
