"""Absences and lates per student."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasktrail.functions.constants import STATUS_ABSENT, STATUS_LATE
from tasktrail.functions.filters import DateLike, Ids, in_scope, within


def attendance_counts(
    attendance: DataFrame, student_ids: Ids = None, start: DateLike = None, end: DateLike = None
) -> DataFrame:
    """Absent and late counts of students who have at least one of each.

    One pass with partial aggregation, so the shuffle carries one row per student and
    task, whatever the number of records of a student.
    """
    status = F.col("attendanceStatusId")
    return (
        within(in_scope(attendance, "studentId", student_ids), "attendanceDate", start, end)
        .filter(status.isin(STATUS_ABSENT, STATUS_LATE) & F.col("studentId").isNotNull())
        .groupBy("studentId")
        .agg(
            F.count_if(status == STATUS_ABSENT).cast("int").alias("absentCount"),
            F.count_if(status == STATUS_LATE).cast("int").alias("lateCount"),
        )
        .filter((F.col("absentCount") > 0) & (F.col("lateCount") > 0))
    )
