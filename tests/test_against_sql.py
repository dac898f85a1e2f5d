"""Every registered query and further arguments against SQL on the same tables."""

import datetime as dt

import pytest

from tasktrail.checks import oracle
from tasktrail.checks.compare import difference, spark_rows, sql_rows
from tasktrail.checks.oracle import statements
from tasktrail.checks.parameters import AS_OF, BUCKETS, RANGE
from tasktrail.checks.registry import _with_micros, registered
from tasktrail import plans
from tasktrail.operators import lookups
from tests.conftest import FOLDER
from tests.schools import NO_BROADCAST, settings

D = dt.date
START, END = RANGE
FLAT = [day for bucket in BUCKETS for day in bucket]
CLIPPED = (
    (D(1996, 6, 1), D(1997, 6, 30)),
    (D(1997, 1, 1), D(2001, 12, 31)),
    (D(1995, 1, 1), D(1998, 6, 30)),
)
FLAT_CLIPPED = [day for bucket in CLIPPED for day in bucket]


def test_every_query_has_its_sql():
    assert set(registered()) == set(statements())


@pytest.mark.parametrize("name", sorted(registered()))
def test_registered_query(spark, sql, name):
    ours = spark_rows(registered()[name](spark, FOLDER))
    assert difference(ours, sql_rows(sql, statements()[name])) is None
    # A result without rows shows nothing; only keys that do not clash rightly have none.
    assert ours[1] or name.endswith("_key_violations")


LARGE = (
    "report_card_all",
    "student_attendance_all",
    "task_detail_latest_all",
    "task_summary_all",
    "progress_individual_all",
    "progress_individual_multidate_latest",
    "progress_benchmark_latest",
    "first_presentations_validated",
    "grade_bands",
    "evaluation_alert_messages",
    "evaluation_alert_user_messages",
)


@pytest.mark.parametrize("name", LARGE)
def test_without_any_broadcast(spark, sql, name, monkeypatch):
    """The way a query takes when every lookup is beyond the broadcast bound."""
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    with settings(spark, NO_BROADCAST):
        ours = spark_rows(registered()[name](spark, FOLDER))
    assert difference(ours, sql_rows(sql, statements()[name])) is None


def only(statement, condition):
    return f"SELECT * FROM ({statement}) WHERE {condition}"


STUDENT = '"studentId" = 101'
VARIANTS = {
    "card of a student": (
        lambda s: plans.report_card(s, 101),
        oracle.report_card(students="= 101"),
    ),
    "card until": (lambda s: plans.report_card(s, 0, None, END), oracle.report_card(None, END)),
    "attendance of students": (
        lambda s: plans.report_student_attendance(s, [3, 4, 5], as_of=AS_OF),
        only(oracle.student_attendance(), '"studentId" IN (3, 4, 5)'),
    ),
    "detail of a teacher and subject": (
        lambda s: _with_micros(plans.task_detail(s, None, 1, 1, as_of=AS_OF)),
        oracle.task_detail(staff_id=1, subject_id=1),
    ),
    "detail of a student": (
        lambda s: _with_micros(plans.task_detail(s, 42, as_of=AS_OF)),
        only(oracle.task_detail(), '"studentId" = 42'),
    ),
    "latest detail of a teacher and subject": (
        lambda s: _with_micros(plans.task_detail_latest(s, None, 2, 2, as_of=AS_OF)),
        oracle.task_detail(latest=True, staff_id=2, subject_id=2),
    ),
    "summary of a teacher": (lambda s: plans.task_summary(s, 1), oracle.task_summary(staff_id=1)),
    "summary of a subject": (
        lambda s: plans.task_summary(s, None, 1, START, END),
        oracle.task_summary(START, END, subject_id=1),
    ),
    "individual of a student": (
        lambda s: plans.progress_report_individual(s, 101, 0, True),
        only(oracle.progress("individual", latest=True), STUDENT),
    ),
    "individual of a subject": (
        lambda s: plans.progress_report_individual(s, None, 1),
        oracle.progress("individual", subject_id=1),
    ),
    "individual latest of a subject until": (
        lambda s: plans.progress_report_individual(s, None, 2, True, None, END),
        oracle.progress("individual", True, None, END, 2),
    ),
    "benchmark of a student": (
        lambda s: plans.progress_report_benchmark(s, 101, as_of=AS_OF),
        only(oracle.progress("benchmark"), STUDENT),
    ),
    "benchmark latest of a subject from": (
        lambda s: plans.progress_report_benchmark(s, None, 1, True, START, as_of=AS_OF),
        oracle.progress("benchmark", True, START, None, 1),
    ),
    "individual buckets of a student": (
        lambda s: plans.progress_report_individual_multidate(s, 101, *FLAT),
        only(oracle.progress_multidate("individual"), STUDENT),
    ),
    "individual buckets that overlap": (
        lambda s: plans.progress_report_individual_multidate(s, None, *FLAT_CLIPPED, 1, True),
        oracle.progress_multidate("individual", True, CLIPPED, 1),
    ),
    "benchmark buckets that overlap": (
        lambda s: plans.progress_report_benchmark_multidate(s, None, *FLAT_CLIPPED, as_of=AS_OF),
        oracle.progress_multidate("benchmark", False, CLIPPED),
    ),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_variant(derived, sql, name):
    report, statement = VARIANTS[name]
    result = report(derived)
    ours = spark_rows(result)
    assert difference(ours, sql_rows(sql, statement)) is None
    assert ours[1].total() > 0
