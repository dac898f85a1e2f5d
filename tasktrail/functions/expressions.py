"""Column expressions: names, ages, elapsed days and sort orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from tasktrail.functions.constants import NO_DATE

SECONDS_PER_DAY = 86400
MICROS_PER_SECOND = 1_000_000


def ntz(moment: dt.datetime) -> Column:
    """A timestamp literal without a time zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def full_name(last: str | Column = "lastName", first: str | Column = "firstName") -> Column:
    """``last, first``; null as soon as one part is null."""
    return F.concat(last, F.lit(", "), first)


def _month_day(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def age_in_years(birth: str | Column, as_of: dt.date | None = None) -> Column:
    """Whole calendar years between ``birth`` and ``as_of`` (default: today).

    Counted on calendar fields, so someone born on 29 February turns a year older
    on 1 March of a common year. A birth date after ``as_of`` gives a number that is
    truncated toward zero.
    """
    born = F.col(birth) if isinstance(birth, str) else birth
    born = born.cast("date")
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    earlier, later = F.least(born, today), F.greatest(born, today)
    years = F.year(later) - F.year(earlier) - (_month_day(later) < _month_day(earlier)).cast("int")
    # least and greatest skip nulls, hence the explicit guard.
    return F.when(born.isNotNull(), F.when(born > today, -years).otherwise(years))


def _epoch_seconds(moment: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz(dt.datetime(1970, 1, 1)), moment) / MICROS_PER_SECOND


def elapsed_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``, rounded half to even.

    The start is first rounded to whole seconds; the end keeps its fraction.
    """
    seconds = _epoch_seconds(end) - F.rint(_epoch_seconds(start))
    return F.rint(seconds / SECONDS_PER_DAY).cast("int")


def since_1900(moment: str | Column) -> Column:
    """The interval from 1900-01-01 to ``moment``."""
    return (F.col(moment) if isinstance(moment, str) else moment) - ntz(NO_DATE)


def ascending(*columns: str) -> list[Column]:
    """Ascending sort keys, nulls last."""
    return [F.col(name).asc_nulls_last() for name in columns]


def descending(*columns: str) -> list[Column]:
    """Descending sort keys, nulls first."""
    return [F.col(name).desc_nulls_first() for name in columns]
