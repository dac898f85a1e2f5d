"""The SQL table functions: the same rows as the Python calls, and plans that use their arguments."""

import datetime as dt
import re

import pytest

from tasktrail import plans
from tasktrail.plans.table_functions import register
from tasktrail.sources.school import School
from tests.schools import D, T, attempt, rows_of, school
from tests.test_plans import explained, scans

DAY = D(2024, 2, 29)
BUCKETS = (D(1995, 1, 1), D(1997, 6, 30), D(1996, 7, 1), D(1998, 12, 31), D(1998, 1, 1), D(2000, 12, 31))
IN_SQL = ", ".join(f"DATE '{day}'" for day in BUCKETS)
FROM, TO = D(1996, 1, 1), D(1998, 12, 31)

CALLS = {
    "report_card(101)": lambda s: plans.report_card(s, 101),
    "report_card(studentId => NULL)": plans.report_card,
    "report_card(evaluationDateTo => DATE '1998-12-31')": lambda s: plans.report_card(s, 0, None, TO),
    "report_student_attendance(3)": lambda s: plans.report_student_attendance(s, 3, as_of=DAY),
    "report_student_attendance()": lambda s: plans.report_student_attendance(s, as_of=DAY),
    "task_detail(101)": lambda s: plans.task_detail(s, 101, as_of=DAY),
    "task_detail(101, 1, 1)": lambda s: plans.task_detail(s, 101, 1, 1, as_of=DAY),
    "task_detail(NULL, NULL, NULL, DATE '1996-01-01')": lambda s: plans.task_detail(
        s, None, None, None, FROM, as_of=DAY
    ),
    "task_detail_latest(subjectId => 2)": lambda s: plans.task_detail_latest(s, None, 0, 2, as_of=DAY),
    "task_summary(3)": lambda s: plans.task_summary(s, 3),
    "task_summary()": plans.task_summary,
    "progress_report_individual(101)": lambda s: plans.progress_report_individual(s, 101),
    "progress_report_individual(101, 1, TRUE, DATE '1996-01-01', DATE '1998-12-31')": lambda s: (
        plans.progress_report_individual(s, 101, 1, True, FROM, TO)
    ),
    "progress_report_individual(subjectId => 2, evaluationDateTo => DATE '1998-12-31')": lambda s: (
        plans.progress_report_individual(s, None, 2, False, None, TO)
    ),
    "progress_report_benchmark(101, latest => TRUE)": lambda s: plans.progress_report_benchmark(
        s, 101, 0, True, as_of=DAY
    ),
    "progress_report_benchmark(NULL, 1, NULL, DATE '1996-01-01')": lambda s: (
        plans.progress_report_benchmark(s, None, 1, None, FROM, as_of=DAY)
    ),
    f"progress_report_individual_multidate(101, {IN_SQL})": lambda s: (
        plans.progress_report_individual_multidate(s, 101, *BUCKETS)
    ),
    "progress_report_individual_multidate(NULL, NULL, DATE '1996-12-31', DATE '1997-01-01', "
    "DATE '1998-12-31', DATE '1999-01-01', NULL)": lambda s: plans.progress_report_individual_multidate(
        s, None, None, D(1996, 12, 31), D(1997, 1, 1), TO, D(1999, 1, 1), None
    ),
    f"progress_report_benchmark_multidate(101, {IN_SQL}, 1, TRUE)": lambda s: (
        plans.progress_report_benchmark_multidate(s, 101, *BUCKETS, subject_id=1, latest=True, as_of=DAY)
    ),
}


@pytest.fixture(scope="module")
def session(spark, derived):
    register(derived, DAY)
    return spark


@pytest.mark.parametrize("call", CALLS)
def test_the_same_rows_as_the_python_call(session, derived, call):
    ours, theirs = session.sql(f"SELECT * FROM {call}"), CALLS[call](derived)
    assert ours.columns == theirs.columns
    assert [field.dataType for field in ours.schema] == [field.dataType for field in theirs.schema]
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    plan = explained(ours)
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert bad not in plan, bad
    # The report of one is sorted, that of all is not; the latest details have no order.
    of_one = ("101" in call or "(3)" in call) and "detail_latest" not in call
    assert ("rangepartitioning" in plan) == of_one


def test_arguments_and_columns_reach_the_scan(session):
    plan = explained(
        session.sql("SELECT teacher, evaluationDate FROM task_detail(101, evaluationDateFrom => DATE '1996-01-01')")
    )
    (scan,) = scans(plan, "task_evaluations")
    assert "EqualTo(studentId,101)" in scan
    assert "GreaterThanOrEqual(evaluationDate,1996-01-01T00:00)" in scan
    assert "note" not in re.search(r"ReadSchema: (.*)", scan).group(1)


def test_branches_that_an_argument_rules_out_are_not_planned(session):
    every = explained(session.sql("SELECT * FROM progress_report_individual(101)"))
    dated = explained(
        session.sql(
            "SELECT * FROM progress_report_individual(101, 0, FALSE, DATE '1996-01-01', DATE '1998-12-31')"
        )
    )
    # With both dates no untried step is looked for; without the flag no latest date is.
    assert "AS tried" in every and "AS tried" not in dated
    assert "max(evaluationDate" not in every


def test_a_statement_may_go_on_from_a_function(session, derived):
    found = session.sql(
        "SELECT subjectName, count(*) AS n FROM task_detail() d JOIN (SELECT 101 AS id) ON id = d.studentId "
        "WHERE evaluationValue >= 7 GROUP BY subjectName"
    )
    detail = plans.task_detail(derived, 101, as_of=DAY).filter("evaluationValue >= 7")
    assert rows_of(found) == rows_of(detail.groupBy("subjectName").count().toDF("subjectName", "n"))


def test_a_school_in_folders_by_year(spark, derived, tmp_path):
    derived.write(str(tmp_path))
    register(School.read(spark, str(tmp_path)), DAY)
    try:
        report = spark.sql("SELECT * FROM task_detail(101, 0, 0, DATE '1996-01-01', DATE '1997-12-31')")
        (scan,) = scans(explained(report), "task_evaluations")
        assert "_year" in scan and ">= 1996" in scan and "<= 1997" in scan
        expected = plans.task_detail(derived, 101, 0, 0, D(1996, 1, 1), D(1997, 12, 31), as_of=DAY)
        assert sorted(map(str, report.collect())) == sorted(map(str, expected.collect()))
    finally:
        register(derived, DAY)


def test_nulls_ties_and_an_empty_school(spark, derived):
    made = school(
        spark,
        task_evaluations=[
            attempt(when=T(2020, 1, 1), kind="FP"),
            attempt(when=T(2020, 1, 5)),
            attempt(when=T(2020, 1, 5), mark="MA"),
            attempt(student=None, when=T(2020, 1, 5)),
            attempt(staff=None, when=T(2020, 1, 6)),
            attempt(task=None),
            attempt(student=2, mark=None, when=None),
        ],
        attendance=[
            (1, 1, dt.datetime(2020, 1, 1), 2, "n", False, "a"),
            (1, 1, dt.datetime(2020, 1, 2), 3, "n", False, "b"),
            (None, 1, dt.datetime(2020, 1, 2), 3, "n", False, "c"),
        ],
    )
    days = ("2020-01-01", "2020-01-05")
    empty = school(spark, **{name: [] for name in ("students", "staff", "tasks", "report_card_grades")})
    try:
        for given in (made, empty):
            register(given, DAY)
            for latest in (False, True):
                ours = spark.sql(f"SELECT * FROM progress_report_individual(latest => {latest})")
                theirs = plans.progress_report_individual(given, None, 0, latest)
                assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
                ours = spark.sql(
                    f"SELECT * FROM progress_report_benchmark(1, 0, {latest}, DATE '{days[0]}', DATE '{days[1]}')"
                )
                theirs = plans.progress_report_benchmark(given, 1, 0, latest, *days, as_of=DAY)
                assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
            for name, report in (
                ("task_detail", plans.task_detail(given, as_of=DAY)),
                ("task_detail_latest", plans.task_detail_latest(given, as_of=DAY)),
                ("report_card", plans.report_card(given)),
                ("task_summary", plans.task_summary(given)),
            ):
                ours = spark.sql(f"SELECT * FROM {name}()")
                assert sorted(map(str, ours.collect())) == sorted(map(str, report.collect()))
    finally:
        register(derived, DAY)
