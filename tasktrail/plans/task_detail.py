"""Task detail: every attempt, or the latest ones, with names and attendance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from tasktrail.functions.expressions import age_in_years, ascending, full_name, since_1900
from tasktrail.functions.filters import DateLike, Ids, equals_or_all, in_scope, sorted_by_default, with_year
from tasktrail.operators.attempts import select_attempts
from tasktrail.operators.attendance import attendance_counts
from tasktrail.operators.lookups import attach, task_catalog
from tasktrail.sources.school import School


def student_profiles(
    school: School, student_ids: Ids, start: DateLike, end: DateLike, as_of: dt.date | None
) -> DataFrame:
    """Name, age and attendance of students with an absence and a late; one row each."""
    students = in_scope(school.students, "studentId", student_ids).select(
        "studentId",
        full_name().alias("student"),
        age_in_years("dateOfBirth", as_of).cast("double").alias("age"),
    )
    return students.join(
        attendance_counts(school.attendance, student_ids, start, end), "studentId"
    )


def _detail(
    school: School,
    student_ids: Ids,
    staff_id: int | None,
    subject_id: int | None,
    start: DateLike,
    end: DateLike,
    as_of: dt.date | None,
    latest: bool,
) -> DataFrame:
    facts = in_scope(school.task_evaluations, "studentId", student_ids)
    columns = with_year(
        facts,
        "studentId",
        "staffId",
        "taskId",
        "evaluationId",
        "evaluationTypeId",
        "evaluationDate",
        "propertyId",
    )
    attempts = select_attempts(facts.select(*columns), latest, start, end).filter(
        equals_or_all("staffId", staff_id)
    )
    catalog = task_catalog(school, subject_id)
    tasks = school.size("tasks")
    if subject_id:
        attempts = attach(attempts, catalog.select("taskId"), "taskId", "left_semi", size=tasks)

    # The one join that may shuffle the attempts comes before the names widen them.
    profiles = student_profiles(school, student_ids, start, end, as_of)
    detail = attach(attempts, profiles, "studentId", size=school.size("students"), spread=True)

    teachers = school.staff.select("staffId", full_name().alias("teacher"))
    for lookup, key, name in (
        (teachers, "staffId", "staff"),
        (catalog, "taskId", "tasks"),
        (school.evaluations, "evaluationId", "evaluations"),
        (school.property, "propertyId", "property"),
        (school.evaluation_types, "evaluationTypeId", "evaluation_types"),
    ):
        detail = attach(detail, lookup, key, size=school.size(name))
    return detail.select(
        "teacher",
        "age",
        "student",
        "gradeLevelName",
        "subjectName",
        "taskName",
        "evaluationDescription",
        "evaluationValue",
        "evaluationDate",
        since_1900("evaluationDate").alias("days"),
        "property",
        "lateCount",
        "absentCount",
        "evaluationTypeDescription",
        "studentId",
        "staffId",
        "subjectId",
        "taskId",
    )


def task_detail(
    school: School,
    student_ids: Ids = None,
    staff_id: int | None = 0,
    subject_id: int | None = 0,
    start: DateLike = None,
    end: DateLike = None,
    as_of: dt.date | None = None,
    ordered: bool | None = None,
) -> DataFrame:
    """Every attempt of students who have an absence and a late in the date range.

    ``staff_id`` and ``subject_id`` 0 or None mean all. ``ordered`` None sorts the
    report of named students and leaves the report of all students unsorted.
    """
    detail = _detail(school, student_ids, staff_id, subject_id, start, end, as_of, latest=False)
    if sorted_by_default(ordered, student_ids):
        # The student id breaks ties, so range partitions stay even when names repeat.
        return detail.orderBy(
            *ascending(
                "teacher",
                "age",
                "student",
                "gradeLevelName",
                "subjectName",
                "taskId",
                "evaluationDate",
                "studentId",
            )
        )
    return detail


def task_detail_latest(
    school: School,
    student_ids: Ids = None,
    staff_id: int | None = 0,
    subject_id: int | None = 0,
    start: DateLike = None,
    end: DateLike = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """``task_detail`` limited to the latest attempts per staff, student and task.

    The latest attempt is taken over all attempts, whatever the date range. Unsorted.
    """
    return _detail(school, student_ids, staff_id, subject_id, start, end, as_of, latest=True)
