"""Path against attempts: what was done, how long it took, in which period."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tasktrail.functions.constants import INCOMPLETE, NO_DATE, NO_TASK, NO_VALUE
from tasktrail.functions.expressions import elapsed_days, full_name, ntz
from tasktrail.functions.filters import DateLike, in_bucket
from tasktrail.operators import lookups
from tasktrail.operators.lookups import attach
from tasktrail.operators.paths import TASK_NAMES
from tasktrail.sources.school import School

Bucket = tuple[DateLike, DateLike]


STEP_KEY = ["studentId", "suggestedTaskId"]


def attempts_on_path(
    path: DataFrame, attempts: DataFrame, first: DataFrame, by_key: bool = False
) -> DataFrame:
    """Every path row with each attempt at its suggested task, as ids.

    An attempt meets the first presentations by the same member of staff; several of
    them repeat the row, none leave the start empty. The attempts are the side that
    streams through both joins, so the ones of a hot key can be split. ``by_key``: the attempts
    lie by staff, student and task, so the first presentations come to them before the path does.
    """
    tried = attempts.select(
        "studentId",
        F.col("taskId").alias("suggestedTaskId"),
        "staffId",
        "evaluationId",
        "evaluationTypeId",
        "evaluationDate",
    )
    started = first.select(
        "staffId", "studentId", F.col("taskId").alias("suggestedTaskId"), "firstPresentationDate"
    )
    key = ["staffId", *STEP_KEY]
    if by_key:
        return tried.join(started, key, "left").join(path, STEP_KEY)
    return tried.join(path, STEP_KEY).join(started, key, "left")


def untried_steps(path: DataFrame, attempted: DataFrame) -> DataFrame:
    """Path rows that are not among the distinct student and task pairs ``attempted``.

    Together with ``attempts_on_path`` this is the left join of path and attempts,
    written as its two halves. In one outer join the attempts would be the side that
    cannot be split, and a student and task with very many attempts would fall to one
    task. This half needs only the pairs, aggregated before the shuffle. Both halves
    shuffle the path alike, so it is worked out once; an anti join would be pushed
    down into the path and undo that, hence the left join with a filter.
    """
    pairs = attempted.select(
        "studentId", F.col("taskId").alias("suggestedTaskId"), F.lit(True).alias("_tried")
    )
    return path.join(pairs, STEP_KEY, "left").filter(F.col("_tried").isNull()).drop("_tried")


# The lookups that name an attempt. Students first, the one that may shuffle the rows, while these
# are narrow; an untried path row names its student by id only.
ATTEMPT_NAMES = ("students", "staff", "evaluation_types", "evaluations")


def attempt_names(school: School) -> tuple[list[str], list[str]]:
    """``ATTEMPT_NAMES`` in two parts: students and what is too large to broadcast; the others."""
    large = [
        name
        for name in ATTEMPT_NAMES
        if name == "students" or school.size(name) > lookups.BROADCAST_BYTES
    ]
    return large, [name for name in ATTEMPT_NAMES if name not in large]


def name_attempts(
    progress: DataFrame, school: School, names: Sequence[str] = ATTEMPT_NAMES
) -> DataFrame:
    """Student, teacher, type and mark of the attempts; unknown ids leave them empty."""
    columns = {
        "students": ("studentId", full_name().alias("student")),
        "staff": ("staffId", full_name().alias("teacher")),
        "evaluation_types": ("evaluationTypeId", "evaluationTypeDescription"),
        "evaluations": ("evaluationId", "evaluationDescription", "evaluationValue"),
    }
    for name in names:
        key, *others = columns[name]
        lookup = getattr(school, name).select(key, *others)
        progress = attach(progress, lookup, key, "left", size=school.size(name))
    return progress


def fill_dates(progress: DataFrame) -> DataFrame:
    """The task of an attempt, and fill values where there is no attempt or no start.

    A path row without an attempt has a null ``evaluationDate``.
    """
    tried = F.col("evaluationDate").isNotNull()

    def date(name: str) -> Column:
        return F.coalesce(F.col(name), ntz(NO_DATE))

    return progress.withColumns(
        {
            "taskId": F.when(tried, F.col("suggestedTaskId")).otherwise(NO_TASK),
            "evaluationDate": date("evaluationDate"),
            "firstPresentationDate": date("firstPresentationDate"),
        }
    )


def fill_attempts(progress: DataFrame) -> DataFrame:
    """Fill values where there is no name, and the elapsed days, of rows with their dates.

    A path row without an attempt shows its student as incomplete too, although the path names
    the student's id.
    """
    days = elapsed_days(F.col("firstPresentationDate"), F.col("evaluationDate"))
    names = ("teacher", "student", "evaluationDescription", "evaluationTypeDescription")
    return progress.select(
        *path_columns(progress),
        "taskId",
        *(F.coalesce(F.col(name), F.lit(INCOMPLETE)).alias(name) for name in names),
        F.coalesce("evaluationValue", F.lit(NO_VALUE)).alias("evaluationValue"),
        "evaluationDate",
        "firstPresentationDate",
        days.alias("elapsedDays"),
    )


def path_columns(progress: DataFrame) -> list[str]:
    """The columns of a progress row that come from its path and its tasks."""
    wanted = (
        "delimiter",
        "studentId",
        "prerequisiteTaskId",
        "suggestedTaskId",
        "daysToComplete",
        "minimumEvaluationId",
        "isRoot",
        *TASK_NAMES,
    )
    return [name for name in wanted if name in progress.columns]


def date_buckets(
    rows: DataFrame, buckets: Sequence[Bucket], column: str = "evaluationDate"
) -> DataFrame:
    """Tag rows with the 1-based number of each date bucket they fall in.

    Overlapping buckets repeat the row, a row in no bucket drops out. The numbers are
    worked out per row: no join, no second scan.
    """
    numbers = [
        F.when(in_bucket(column, start, end), F.lit(number))
        for number, (start, end) in enumerate(buckets, 1)
    ]
    return rows.filter(in_any_bucket(buckets, column)).select(
        F.explode(F.array_compact(F.array(*numbers))).alias("delimiter"), "*"
    )


def in_any_bucket(buckets: Sequence[Bucket], column: str = "evaluationDate") -> Column:
    """True where the date falls in at least one bucket; reaches the file scan."""
    return reduce(lambda a, b: a | b, (in_bucket(column, start, end) for start, end in buckets))
