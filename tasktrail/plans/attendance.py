"""Attendance report: absences and lates with age."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from tasktrail.functions.expressions import age_in_years, ascending, descending, full_name
from tasktrail.functions.filters import DateLike, Ids, sorted_by_default
from tasktrail.operators.attendance import attendance_counts
from tasktrail.operators.lookups import attach
from tasktrail.sources.school import School


def report_student_attendance(
    school: School,
    student_ids: Ids = None,
    start: DateLike = None,
    end: DateLike = None,
    as_of: dt.date | None = None,
    ordered: bool | None = None,
) -> DataFrame:
    """Absent and late counts of every student who has both.

    ``ordered`` None sorts the report of named students and leaves that of all unsorted.
    """
    counts = attendance_counts(school.attendance, student_ids, start, end)
    students = school.students.select(
        "studentId",
        age_in_years("dateOfBirth", as_of).cast("double").alias("age"),
        full_name().alias("student"),
    )
    report = attach(counts, students, "studentId", size=school.size("students")).select(
        "absentCount", "lateCount", "age", "student", "studentId"
    )
    if not sorted_by_default(ordered, student_ids):
        return report
    return report.orderBy(
        *descending("absentCount", "lateCount", "age"), *ascending("student", "studentId")
    )
