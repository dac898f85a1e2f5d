"""Row predicates for optional arguments, built before planning.

An argument that is left out still requires a non-null column: the reports never
show a row whose filtered column is null, whether or not a filter value was given.
Every predicate compares a bare column with a literal, so it reaches the file scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tasktrail.functions.constants import ALL_IDS

DateLike = dt.date | str | None
Ids = int | Iterable[int] | DataFrame | None


def as_date(value: DateLike) -> dt.date | None:
    """Accept a date or an ISO text; a datetime counts as its date."""
    if isinstance(value, str):
        return dt.date.fromisoformat(value)
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def all_known(*columns: str) -> Column:
    """No column is null; unlike ``dropna`` this reaches the file scan."""
    return reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in columns))


def in_date_range(column: str, start: DateLike = None, end: DateLike = None) -> Column:
    """``start <= column <= end`` with open ends.

    The end is midnight of that day: a time stamp later on the end day is outside.
    """
    start, end = as_date(start), as_date(end)
    moment = F.col(column)
    keep = moment.isNotNull()
    if start is not None:
        keep = keep & (moment >= F.lit(start))
    if end is not None:
        keep = keep & (moment <= F.lit(end))
    return keep


def sorted_by_default(ordered: bool | None, ids: Ids) -> bool:
    """Unless told otherwise, the report of named ids is sorted and that of all ids is not."""
    return ids is not None if ordered is None else ordered


# Facts that were written in folders by year carry the year under this name.
YEAR = "_year"


def within(
    rows: DataFrame, column: str, start: DateLike = None, end: DateLike = None
) -> DataFrame:
    """Rows in the date range; of facts in folders by year only those years are read."""
    kept = rows.filter(in_date_range(column, start, end))
    if YEAR in rows.columns:
        start, end = as_date(start), as_date(end)
        if start is not None:
            kept = kept.filter(F.col(YEAR) >= start.year)
        if end is not None:
            kept = kept.filter(F.col(YEAR) <= end.year)
    return kept


def without_year(rows: DataFrame) -> DataFrame:
    return rows.drop(YEAR)


def with_year(rows: DataFrame, *columns: str) -> list[str]:
    """``columns``, and the year where the rows have it."""
    return [*columns, YEAR] if YEAR in rows.columns else list(columns)


def in_bucket(column: str, start: DateLike, end: DateLike) -> Column:
    """``start <= column <= end`` where a missing bound matches nothing."""
    if as_date(start) is None or as_date(end) is None:
        return F.lit(False)
    return in_date_range(column, start, end)


def equals_or_all(column: str, value: int | None, everything: int | None = ALL_IDS) -> Column:
    """Equality filter that is open for ``None`` and for the ``everything`` value."""
    keep = F.col(column).isNotNull()
    if value is None or value == everything:
        return keep
    return keep & (F.col(column) == F.lit(value))


def in_scope(rows: DataFrame, column: str, ids: Ids) -> DataFrame:
    """Restrict ``rows`` to one id, several ids or the ids of a DataFrame.

    ``None`` keeps every id. A DataFrame of ids is matched with a semi join on its
    first column, so the ids never pass through the driver.
    """
    if ids is None:
        return rows
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return rows.join(wanted, column, "left_semi")
    if isinstance(ids, int):
        return rows.filter(F.col(column) == F.lit(ids))
    return rows.filter(F.col(column).isin([int(one) for one in ids]))
