"""A small hand-made school; tests replace the tables they are about."""

from __future__ import annotations

import contextlib
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tasktrail.sources.schemas import TABLES
from tasktrail.sources.school import School

D = dt.date
T = dt.datetime

# Students 1 and 2, teachers 1 and 2, tasks 10 to 13 of subjects 1 and 2.
ROWS = {
    "task_evaluations": [],
    "attendance": [],
    "students": [(1, "Ash", "Ann", D(2010, 5, 1)), (2, "Birch", "Bob", D(2004, 2, 29))],
    "staff": [(1, "Oak", "Olga", 101), (2, "Pine", "Paul", 102)],
    "staff_students": [(1, 1), (1, 2), (2, 1)],
    "tasks": [
        (10, "count", 1, 1),
        (11, "add", 1, 1),
        (12, "read", 2, 2),
        (13, "write", 2, 2),
    ],
    "subject_categories": [(1, "numbers", 1), (2, "letters", 2)],
    "subjects": [(1, "maths", 1), (2, "language", 2)],
    "grade_levels": [(1, "first"), (2, "second")],
    "evaluations": [("NA", "Not attempted", 0), ("WO", "Working", 4), ("NM", "Near", 7), ("MA", "Mastered", 10)],
    "evaluation_types": [("FP", "First presentation"), ("EV", "Evaluation"), ("AS", "Assignment")],
    "property": [(0, "school"), (1, "home")],
    "age_groups": [(1, 5, 15, "young"), (2, 15, 20, "old")],
    "benchmark_task_paths": [(1, 10, 11, 30, "MA"), (2, 10, 12, 40, "MA")],
    "individual_task_paths": [(1, 10, 11, 30, "MA")],
    "report_card_categories": [(1, "Arithmetic"), (2, "Literacy")],
    "report_card_grades": [(0, 3, "D"), (4, 5, "C"), (6, 8, "B"), (9, 10, "A")],
    "users": [(101, "T"), (102, "T"), (201, "A"), (202, "A")],
}


def table(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TABLES[name])


def school(spark: SparkSession, **rows: list[tuple]) -> School:
    """The standard school with some tables given as rows."""
    unknown = set(rows) - set(ROWS)
    assert not unknown, unknown
    return School({name: table(spark, name, made) for name, made in {**ROWS, **rows}.items()})


def attempt(
    student=1, staff=1, task=11, mark="WO", kind="EV", when=T(2020, 1, 1), place=0, note="n",
    flag=False, change=None,
):
    change = change or f"{student}/{staff}/{task}/{mark}/{kind}/{when}"
    return (student, staff, task, mark, kind, when, place, note, flag, change)


def presence(student=1, staff=1, when=T(2020, 1, 1), status=2, note="n", flag=False, change=None):
    return (student, staff, when, status, note, flag, change or f"{student}/{when}/{status}")


def rows_of(frame: DataFrame, *columns: str) -> list[tuple]:
    """Rows in result order, cut to some columns."""
    return [tuple(row) for row in (frame.select(*columns) if columns else frame).collect()]


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
