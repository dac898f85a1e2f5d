"""Report card: mean marks as letter grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasktrail.functions.constants import ALL_IDS, EVALUATION
from tasktrail.functions.expressions import ascending, full_name
from tasktrail.functions.filters import DateLike, Ids, in_scope, sorted_by_default, within
from tasktrail.operators.bands import grade_bands
from tasktrail.operators.lookups import attach, task_catalog
from tasktrail.sources.school import School


def average_marks(
    school: School, student_ids: Ids = None, start: DateLike = None, end: DateLike = None
) -> DataFrame:
    """Rounded mean mark per student name, teacher name, subject and category.

    Marks are first summed per ids, ahead of the only shuffle of the fact table, so
    the student table meets a few rows per student instead of every attempt. Names
    are grouped last: people who share a full name share a mean.
    """
    marks = within(
        in_scope(school.task_evaluations, "studentId", student_ids), "evaluationDate", start, end
    ).filter((F.col("evaluationTypeId") == EVALUATION) & F.col("studentId").isNotNull())
    catalog = task_catalog(school, with_grades=False)
    marks = attach(
        marks.select("studentId", "staffId", "taskId", "evaluationId"),
        school.evaluations.select("evaluationId", "evaluationValue"),
        "evaluationId",
        size=school.size("evaluations"),
    )
    marks = attach(
        marks,
        catalog.select("taskId", "reportCardCategoryId", "subjectId"),
        "taskId",
        size=school.size("tasks"),
    )
    sums = marks.groupBy("studentId", "staffId", "reportCardCategoryId", "subjectId").agg(
        F.sum("evaluationValue").alias("total"), F.count("evaluationValue").alias("marks")
    )
    named = attach(
        sums,
        school.students.select("studentId", full_name().alias("student")),
        "studentId",
        size=school.size("students"),
    )
    named = attach(
        named,
        school.staff.select("staffId", full_name().alias("teacher")),
        "staffId",
        size=school.size("staff"),
    )
    named = attach(
        named,
        school.report_card_categories,
        "reportCardCategoryId",
        size=school.size("report_card_categories"),
    )
    subjects = school.subjects.select("subjectId", "subjectName")
    named = attach(named, subjects, "subjectId", size=school.size("subjects"))
    mean = F.try_divide(F.sum("total"), F.sum("marks"))
    return named.groupBy(
        "student",
        "teacher",
        "reportCardCategoryId",
        "reportCardCategoryName",
        "subjectId",
        "subjectName",
    ).agg(F.round(mean).alias("task_average"))


def report_card(
    school: School,
    student_ids: Ids = ALL_IDS,
    start: DateLike = None,
    end: DateLike = None,
    ordered: bool | None = None,
) -> DataFrame:
    """Letter grade per student, teacher, subject and report card category.

    ``student_ids`` 0 or None means every student. ``ordered`` None sorts the card of named
    students and leaves the cards of all students unsorted.
    """
    if isinstance(student_ids, int) and student_ids == ALL_IDS:
        student_ids = None
    graded = grade_bands(average_marks(school, student_ids, start, end), school)
    card = graded.select(
        "student",
        "teacher",
        "subjectName",
        "reportCardCategoryName",
        "task_average",
        "rangeBottom",
        "rangeTop",
        F.col("gradeLetter").alias("letterGrade"),
    )
    if not sorted_by_default(ordered, student_ids):
        return card
    return card.orderBy(*ascending("student", "subjectName", "task_average"))
