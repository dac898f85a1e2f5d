"""Task summary: a teacher's class mean per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasktrail.functions.expressions import ascending, full_name
from tasktrail.functions.filters import DateLike, Ids, in_scope, sorted_by_default, with_year
from tasktrail.operators.attempts import select_attempts
from tasktrail.operators.lookups import attach, task_catalog
from tasktrail.sources.school import School


def _roster(school: School, staff_ids: Ids) -> DataFrame:
    """Known students of each teacher with the number of times they are listed."""
    listed = (
        in_scope(school.staff_students, "staffId", staff_ids)
        .groupBy("staffId", "studentId")
        .agg(F.count("*").alias("listings"))
    )
    students = school.students.select("studentId")
    return attach(listed, students, "studentId", "left_semi", size=school.size("students"))


def task_summary(
    school: School,
    staff_ids: Ids = None,
    subject_id: int | None = 0,
    start: DateLike = None,
    end: DateLike = None,
    ordered: bool | None = None,
) -> DataFrame:
    """Mean mark per teacher and task name over the latest attempts of listed students.

    A student listed several times for a teacher counts as often. Marks are summed per
    staff and task id before any name is attached, so hot teachers and tasks shrink to
    one row each ahead of the shuffle. ``ordered`` None sorts the summary of named staff
    and leaves that of all staff unsorted.
    """
    attempts = in_scope(school.task_evaluations, "staffId", staff_ids)
    attempts = attempts.select(
        *with_year(attempts, "staffId", "studentId", "taskId", "evaluationId", "evaluationDate")
    )
    marks = attach(
        select_attempts(attempts, True, start, end),
        school.evaluations.select("evaluationId", "evaluationValue"),
        "evaluationId",
        size=school.size("evaluations"),
    )
    catalog = task_catalog(school, subject_id)
    tasks = school.size("tasks")
    if subject_id:
        marks = attach(marks, catalog.select("taskId"), "taskId", "left_semi", size=tasks)
    counted = attach(
        marks.select("staffId", "studentId", "taskId", "evaluationValue"),
        _roster(school, staff_ids),
        ["staffId", "studentId"],
        size=school.size("staff_students"),
        spread=True,
    )
    value, listings = F.col("evaluationValue"), F.col("listings")
    sums = counted.groupBy("staffId", "taskId").agg(
        F.sum(value * listings).alias("total"),
        F.sum(F.when(value.isNotNull(), listings)).alias("marks"),
    )
    teachers = school.staff.select("staffId", full_name().alias("teacher"))
    named = attach(sums, teachers, "staffId", size=school.size("staff"))
    named = attach(named, catalog, "taskId", size=tasks)
    summary = (
        named.groupBy(
            "teacher", "gradeLevelName", "subjectName", "taskName", "staffId", "subjectId"
        )
        .agg(F.try_divide(F.sum("total"), F.sum("marks")).alias("evaluationAverage"))
        .select(
            "teacher",
            "gradeLevelName",
            "subjectName",
            "taskName",
            "evaluationAverage",
            "staffId",
            "subjectId",
        )
    )
    if not sorted_by_default(ordered, staff_ids):
        return summary
    return summary.orderBy(*ascending("teacher", "gradeLevelName", "subjectName", "taskName"))
