"""Names, ages, elapsed days and optional filters on single rows."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tasktrail.functions.expressions import (
    age_in_years,
    ascending,
    descending,
    elapsed_days,
    full_name,
    since_1900,
)
from tasktrail.functions.filters import as_date, equals_or_all, in_bucket, in_date_range, in_scope

T, D = dt.datetime, dt.date


def ages(spark, pairs):
    frame = spark.createDataFrame(pairs, "born date, today date")
    out = []
    for born, today in pairs:
        row = frame.filter((F.col("born") == born) & (F.col("today") == today)).limit(1)
        out.append(row.select(age_in_years("born", today).alias("age")).first()["age"])
    return out


@pytest.mark.parametrize(
    "born, today, age",
    [
        (D(2004, 2, 29), D(2023, 2, 28), 18),
        (D(2004, 2, 29), D(2023, 3, 1), 19),
        (D(2004, 2, 29), D(2024, 2, 29), 20),
        (D(2010, 5, 1), D(2020, 4, 30), 9),
        (D(2010, 5, 1), D(2020, 5, 1), 10),
        (D(2024, 7, 1), D(2024, 2, 1), 0),
        (D(2026, 7, 1), D(2024, 2, 1), -2),
    ],
)
def test_age(spark, born, today, age):
    assert ages(spark, [(born, today)]) == [age]


def test_age_of_unknown_birth_date(spark):
    frame = spark.createDataFrame([(None,)], "born date")
    assert frame.select(age_in_years("born", D(2020, 1, 1))).first()[0] is None


def test_age_defaults_to_today(spark):
    row = spark.range(1).select(
        age_in_years(F.add_months(F.current_date(), -12 * 7 - 6)).alias("age")
    ).first()
    assert row["age"] == 7


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.dates(D(1950, 1, 1), D(2040, 12, 31)), min_size=40, max_size=40), st.dates(D(1990, 1, 1), D(2030, 12, 31)))
def test_age_equals_sql_age(spark, sql, born, today):
    frame = spark.createDataFrame([(day,) for day in born], "born date")
    ours = [row[0] for row in frame.select(age_in_years("born", today)).collect()]
    theirs = [
        sql.execute("SELECT date_part('year', age(?::TIMESTAMP, ?::TIMESTAMP))", [today, day]).fetchone()[0]
        for day in born
    ]
    assert ours == theirs


@pytest.mark.parametrize(
    "start, end, days",
    [
        (T(2020, 1, 1), T(2020, 1, 2, 12), 2),  # 1.5 rounds to even
        (T(2020, 1, 1), T(2020, 1, 3, 12), 2),  # 2.5 rounds to even
        (T(2020, 1, 1), T(2020, 1, 2, 14, 24), 2),  # 1.6
        (T(2020, 1, 2), T(2020, 1, 1, 12), 0),  # -0.5
        (T(2020, 1, 3), T(2020, 1, 1, 9), -2),  # -1.6
        (T(1900, 1, 1), T(2020, 1, 1), 43829),
        # The start is rounded to a whole second first, the end is not.
        (T(2020, 1, 1, 0, 0, 0, 600000), T(2020, 1, 1, 12, 0, 0, 500000), 0),
        (T(2020, 1, 1, 0, 0, 0, 400000), T(2020, 1, 1, 12, 0, 0, 500000), 1),
    ],
)
def test_elapsed_days(spark, start, end, days):
    frame = spark.createDataFrame([(start, end)], "a timestamp_ntz, b timestamp_ntz")
    assert frame.select(elapsed_days(F.col("a"), F.col("b"))).first()[0] == days


def test_since_1900_is_an_interval(spark):
    frame = spark.createDataFrame([(T(1900, 1, 3, 6),)], "a timestamp_ntz")
    days = frame.select(since_1900("a").alias("days"))
    assert days.dtypes == [("days", "interval day to second")]
    assert days.first()["days"] == dt.timedelta(days=2, hours=6)


def test_full_name_is_null_when_a_part_is(spark):
    frame = spark.createDataFrame([("A", "B"), ("A", None)], "lastName string, firstName string")
    assert [row[0] for row in frame.select(full_name()).collect()] == ["A, B", None]


def test_null_order(spark):
    frame = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert [r[0] for r in frame.orderBy(*ascending("a")).collect()] == [1, 2, None]
    assert [r[0] for r in frame.orderBy(*descending("a")).collect()] == [None, 2, 1]


MOMENTS = [T(2020, 1, 1), T(2020, 1, 31), T(2020, 1, 31, 12), None]


@pytest.mark.parametrize(
    "start, end, kept",
    [
        (None, None, 3),  # a null date never passes
        ("2020-01-01", None, 3),
        (D(2020, 1, 2), None, 2),
        (None, "2020-01-31", 2),  # noon of the last day is outside
        ("2020-01-31", "2020-01-31", 1),
    ],
)
def test_date_range(spark, start, end, kept):
    frame = spark.createDataFrame([(m,) for m in MOMENTS], "a timestamp_ntz")
    assert frame.filter(in_date_range("a", start, end)).count() == kept


def test_bucket_without_a_bound_is_empty(spark):
    frame = spark.createDataFrame([(m,) for m in MOMENTS], "a timestamp_ntz")
    assert frame.filter(in_bucket("a", None, "2020-01-31")).count() == 0
    assert frame.filter(in_bucket("a", "2020-01-01", "2020-01-31")).count() == 2


def test_as_date():
    assert as_date("2020-01-02") == as_date(T(2020, 1, 2, 3)) == D(2020, 1, 2)
    assert as_date(None) is None


def test_equals_or_all(spark):
    frame = spark.createDataFrame([(0,), (1,), (None,)], "a int")
    assert frame.filter(equals_or_all("a", 0)).count() == 2
    assert frame.filter(equals_or_all("a", None)).count() == 2
    assert frame.filter(equals_or_all("a", 1)).count() == 1
    assert frame.filter(equals_or_all("a", 0, everything=None)).count() == 1


def test_scope(spark):
    frame = spark.createDataFrame([(0,), (1,), (1,), (2,)], "a int")
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert in_scope(frame, "a", None).count() == 4
    assert in_scope(frame, "a", 0).count() == 1
    assert in_scope(frame, "a", [0, 1]).count() == 3
    assert in_scope(frame, "a", ids).count() == 3
