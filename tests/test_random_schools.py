"""Reports on random small schools with nulls, copies, ties and unknown ids, against SQL."""

import datetime as dt
import random

import duckdb
import pytest

from tasktrail.checks import oracle
from tasktrail.checks.compare import difference, spark_rows, sql_rows
from tasktrail.checks.registry import _with_micros
from tasktrail import plans
from tasktrail.sources.schemas import TABLES
from tests.schools import school

D, T = dt.date, dt.datetime
AS_OF = D(2024, 2, 29)
SQL_TYPES = {
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}
# The names under which the check SQL knows the tables.
PRELUDE = """
WITH te AS (FROM task_evaluations),
catalog AS (
  SELECT t.*, "subjectCategoryName", "subjectId", "subjectName", "gradeLevelName", "reportCardCategoryName"
  FROM tasks t JOIN subject_categories USING ("subjectCategoryId") JOIN subjects USING ("subjectId")
    JOIN grade_levels USING ("gradeLevelId") JOIN report_card_categories USING ("reportCardCategoryId")),
grades AS (FROM report_card_grades),
individual_edges AS (
  SELECT "studentId", "prerequisiteTaskId", "suggestedTaskId", "daysToComplete" AS days,
    "minimumEvaluationId" AS minimum FROM individual_task_paths),
benchmark_edges AS (
  SELECT "ageGroupId", "prerequisiteTaskId", "suggestedTaskId", "daysToComplete" AS days,
    "minimumEvaluationId" AS minimum FROM benchmark_task_paths),
age_groups AS (
  SELECT "ageGroupId", "ageLowerRange" AS lower, "ageUpperRange" AS upper, "ageGroupDescription"
  FROM main.age_groups)
"""


def random_rows(seed: int) -> dict[str, list[tuple]]:
    r = random.Random(seed)

    def some(*values, null=0.05):
        return None if r.random() < null else r.choice(values)

    def moment():
        day = T(2020, 1, 1) + dt.timedelta(days=r.randint(0, 9))
        return day + r.choice([dt.timedelta(0)] * 3 + [dt.timedelta(hours=12), dt.timedelta(seconds=0.6)])

    marks = ("NA", "WO", "NM", "MA")
    tasks = list(range(1, 9))

    def attempt(n):
        return (
            some(1, 2, 3, 4, 9), some(1, 2, 3, 9), some(*tasks, 99), some(*marks, "??"),
            some("FP", "EV", "AS", "??"), some(*(moment() for _ in range(2))), some(0, 1, 9),
            some("a", "b"), some(True, False), str(n),
        )

    def step(owner):
        return (
            owner, some(*tasks, 99), some(*tasks, 99), r.choice([10, 10, 20]),
            some(*marks, "NN", "??"),
        )

    attempts = [attempt(n) for n in range(150)]
    attempts += [(*row[:-1], f"{row[-1]} again") for row in r.sample(attempts, 10)]
    edges = [step(r.choice([1, 2, 3, 4, 9])) for _ in range(30)]
    return {
        "task_evaluations": attempts,
        "attendance": [
            (some(1, 2, 3, 4, 9), some(1, 2), some(moment()), some(1, 2, 3), some("x"), some(True, False), str(n))
            for n in range(60)
        ],
        "students": [
            (n, some("Ash", "Birch"), some("Ann", "Bob"), some(D(2010 + n, r.randint(1, 12), 28)))
            for n in (1, 2, 3, 4, 5)
        ],
        "staff": [(n, some("Oak", null=0), some("Olga", "Paul"), some(100 + n)) for n in (1, 2, 3)],
        "staff_students": [(r.randint(1, 3), r.randint(1, 5)) for _ in range(12)],
        "tasks": [(n, f"task{n // 2}", some(1, 2, 3, null=0.1), r.randint(1, 2)) for n in tasks],
        "subject_categories": [(1, "one", 1), (2, "two", 2)],
        "subjects": [(1, "maths", 1), (2, "language", 2)],
        "grade_levels": [(1, "first"), (2, "second")],
        "age_groups": [(1, 5, 11, "young"), (2, 10, 13, "old"), (3, 9, 12, r.choice(["young", "mid"]))],
        "benchmark_task_paths": [step(r.randint(1, 3)) for _ in range(20)],
        "individual_task_paths": edges + r.sample(edges, 5),
        "report_card_grades": [(0, 3, "D"), (3, 6, "C"), (8, 10, "A")],
    }


def connect(rows: dict[str, list[tuple]]) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name, schema in TABLES.items():
        columns = ", ".join(
            f'"{field.name}" {SQL_TYPES[field.dataType.simpleString()]}' for field in schema.fields
        )
        connection.execute(f"CREATE TABLE {name} ({columns})")
        if rows[name]:
            places = ", ".join("?" * len(schema.fields))
            connection.executemany(f"INSERT INTO {name} VALUES ({places})", rows[name])
    return connection


START, END = D(2020, 1, 3), D(2020, 1, 7)
BUCKETS = (
    (D(2020, 1, 2), D(2020, 1, 5)),
    (D(2020, 1, 4), D(2020, 1, 30)),
    (D(2020, 1, 5), D(2020, 1, 8)),
)
FLAT = [day for bucket in BUCKETS for day in bucket]


def cases():
    yield "card", lambda s: plans.report_card(s), oracle.report_card()
    yield "card dated", lambda s: plans.report_card(s, 0, START, END), oracle.report_card(START, END)
    yield (
        "attendance",
        lambda s: plans.report_student_attendance(s, None, START, as_of=AS_OF),
        oracle.student_attendance(START),
    )
    yield "detail", lambda s: _with_micros(plans.task_detail(s, as_of=AS_OF)), oracle.task_detail()
    yield (
        "detail latest",
        lambda s: _with_micros(plans.task_detail_latest(s, None, 0, 1, START, END, as_of=AS_OF)),
        oracle.task_detail(True, START, END, subject_id=1),
    )
    yield "summary", lambda s: plans.task_summary(s, None, 0, None, END), oracle.task_summary(None, END)
    for kind, report, buckets in (
        (
            "individual",
            plans.progress_report_individual,
            plans.progress_report_individual_multidate,
        ),
        (
            "benchmark",
            lambda *a, **o: plans.progress_report_benchmark(*a, as_of=AS_OF, **o),
            lambda *a, **o: plans.progress_report_benchmark_multidate(*a, as_of=AS_OF, **o),
        ),
    ):
        yield kind, report, oracle.progress(kind)
        yield (
            f"{kind} latest until",
            lambda s, report=report: report(s, None, 0, True, None, END),
            oracle.progress(kind, True, None, END),
        )
        yield (
            f"{kind} subject dated",
            lambda s, report=report: report(s, None, 2, False, START, END),
            oracle.progress(kind, False, START, END, 2),
        )
        yield (
            f"{kind} buckets",
            lambda s, buckets=buckets: buckets(s, None, *FLAT, 0, True),
            oracle.progress_multidate(kind, True, BUCKETS),
        )
    yield "notes", lambda s: plans.attendance_alerts(s).messages, oracle.attendance_messages()
    yield "marks", lambda s: plans.evaluation_alerts(s).messages, oracle.evaluation_messages()
    yield (
        "recipients",
        lambda s: plans.evaluation_alerts(s).user_messages,
        oracle.user_messages("te", "task_evaluation"),
    )
    yield "stored", lambda s: plans.attendance_alerts(s).stored, oracle.stored("attendance")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_school(spark, monkeypatch, seed):
    monkeypatch.setattr(oracle, "PRELUDE", PRELUDE)
    monkeypatch.setattr(oracle, "AS_OF", AS_OF)
    from tests.schools import ROWS

    rows = {**ROWS, **random_rows(seed)}
    made, connection = school(spark, **rows), connect(rows)
    problems = {}
    for name, report, statement in cases():
        problem = difference(spark_rows(report(made)), sql_rows(connection, statement))
        if problem:
            problems[name] = problem
    assert problems == {}
