"""Progress reports: task path against attempts, planned against actual days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tasktrail.functions.expressions import ascending
from tasktrail.functions.filters import DateLike, Ids, in_scope, sorted_by_default, with_year
from tasktrail.operators import lookups
from tasktrail.operators.attempts import attempted_tasks, first_presentations, select_attempts
from tasktrail.operators.keys import ATTEMPT_MOMENT, FIRST_MOMENT, PATH_STEP, require_unique
from tasktrail.operators.lookups import attach, task_catalog
from tasktrail.operators.maintained import MaintainedAttempts
from tasktrail.operators.paths import (
    benchmark_path,
    individual_path,
    with_minimum_value,
    with_task_names,
)
from tasktrail.operators.progress import (
    Bucket,
    attempt_names,
    attempts_on_path,
    date_buckets,
    fill_attempts,
    fill_dates,
    in_any_bucket,
    name_attempts,
    untried_steps,
)
from tasktrail.sources.school import School, row_width

REPORT_COLUMNS = (
    "minimumEvaluationValue",
    "prerequisiteTaskName",
    "taskName",
    "subjectCategoryName",
    "subjectName",
    "gradeLevelName",
    "studentId",
    "prerequisiteTaskId",
    "suggestedTaskId",
    "recommededDaysToComplete",
    "taskId",
    "teacher",
    "student",
    "evaluationDescription",
    "evaluationTypeDescription",
    "evaluationDate",
    "evaluationValue",
    "firstPresentationDate",
    "daysToComplete",
    "differenceDaysToComplete",
)
ORDER = (
    "gradeLevelName",
    "subjectName",
    "subjectCategoryName",
    "suggestedTaskId",
    "evaluationDate",
    # Breaks ties, so that the untried rows of one task do not share a range partition.
    "studentId",
)


def _size(student_ids: DataFrame) -> int:
    """Bytes that the distinct ids of a DataFrame take in memory. Runs a job."""
    ids = student_ids.select(F.col(student_ids.columns[0]).alias("studentId")).distinct()
    return ids.agg(F.sum(row_width(ids))).first()[0] or 0


def _facts(
    school: School, attempts: DataFrame, student_ids: Ids, subject_id: int | None, strict: bool
) -> DataFrame:
    """The attempt columns a progress report reads; of one subject's tasks, if given.

    A strict report checks the attempts of all subjects. Attempts meet the path, which has
    the wanted students only. So a DataFrame of ids that is too large to broadcast is not
    matched with the attempts as well, which would shuffle all of them once more per use.
    """
    facts = attempts
    if strict or not isinstance(student_ids, DataFrame):
        facts = in_scope(attempts, "studentId", student_ids)
    elif (size := _size(student_ids)) <= lookups.BROADCAST_BYTES:
        wanted = student_ids.select(F.col(student_ids.columns[0]).alias("studentId")).distinct()
        facts = attach(attempts, wanted, "studentId", "left_semi", size=size)
    facts = facts.select(
        *with_year(
            facts, "studentId", "staffId", "taskId", "evaluationId", "evaluationTypeId", "evaluationDate"
        )
    )
    if subject_id and not strict:
        listed = task_catalog(school, subject_id).select("taskId")
        facts = attach(facts, listed, "taskId", "left_semi", size=school.size("tasks"))
    return facts


def _sources(
    school: School,
    maintained: MaintainedAttempts | None,
    latest: bool | None,
    student_ids: Ids,
    subject_id: int | None,
    strict: bool,
) -> tuple[DataFrame, DataFrame, bool | None]:
    """Where attempts and first presentations come from, and whether to look for the latest.

    Maintained latest attempts need no search: limiting them by date afterwards is what
    ``select_attempts`` does with those it finds.
    """
    scope = (student_ids, subject_id, strict)
    if maintained is None:
        facts = _facts(school, school.task_evaluations, *scope)
        return facts, facts, latest
    every = _facts(school, maintained.attempts(), *scope)
    chosen = _facts(school, maintained.latest(), *scope) if latest else every
    return chosen, every, False


def _check_keys(path: DataFrame, attempts: DataFrame, first: DataFrame) -> None:
    require_unique(first, FIRST_MOMENT, "first presentations")
    require_unique(attempts, ATTEMPT_MOMENT, "attempts")
    require_unique(path, PATH_STEP, "task path")


def _columns(named: DataFrame) -> DataFrame:
    """The report columns of rows that carry the attempt's columns and all names."""
    days = F.col("elapsedDays")
    delimiter = ["delimiter"] if "delimiter" in named.columns else []
    return named.withColumns(
        {
            "recommededDaysToComplete": F.col("daysToComplete"),
            "differenceDaysToComplete": F.col("daysToComplete") - days,
            "daysToComplete": days,
        }
    ).select(*delimiter, *REPORT_COLUMNS)


def _finish(filled: DataFrame, school: School, ordered: bool) -> DataFrame:
    """Task names, report columns and order for rows that carry the attempt's columns."""
    report = _columns(with_task_names(filled, school))
    delimiter = ["delimiter"] if "delimiter" in filled.columns else []
    return report.orderBy(*ascending(*delimiter, *ORDER)) if ordered else report


def _report(
    school: School,
    edges: DataFrame,
    path: DataFrame,
    facts: DataFrame,
    first: DataFrame,
    latest: bool | None,
    start: DateLike,
    end: DateLike,
    strict: bool,
    ordered: bool,
) -> DataFrame:
    """With both dates only attempted path rows are reported, otherwise all of them.

    Rows are shuffled while they are narrow: names that are broadcast come after the last shuffle,
    which is that of the order. Before it, rows of one task lie together and share their names.
    """
    attempts = select_attempts(facts, latest, start, end, all_read=True)
    if strict:
        _check_keys(path, attempts, first)
    shuffled, broadcast = attempt_names(school)
    met = attempts_on_path(path, attempts, first, by_key=bool(latest))
    progress = name_attempts(met, school, shuffled)
    if start is None or end is None:
        untried = untried_steps(path, attempted_tasks(facts, latest, start, end))
        progress = progress.unionByName(untried, allowMissingColumns=True)
    named = with_task_names(fill_dates(progress), school, edges)
    if ordered:
        # The sort finds its rows dealt this way and does not deal them again.
        named = named.repartitionByRange(*ascending(*ORDER))
    filled = fill_attempts(name_attempts(named, school, broadcast))
    report = _columns(with_minimum_value(filled, school))
    return report.orderBy(*ascending(*ORDER)) if ordered else report


def _bucket_report(
    school: School,
    path: DataFrame,
    facts: DataFrame,
    first: DataFrame,
    latest: bool | None,
    buckets: tuple[Bucket, ...],
    strict: bool,
    ordered: bool,
) -> DataFrame:
    """Attempts before the first start or after the last end belong to no bucket.

    Equal report rows of one bucket merge; names that follow from ids come after that.
    """
    attempts = select_attempts(facts, latest, buckets[0][0], buckets[-1][1])
    if strict:
        _check_keys(path, attempts, first)
    wanted = attempts.filter(in_any_bucket(buckets))
    progress = date_buckets(attempts_on_path(path, wanted, first), buckets)
    named = fill_dates(name_attempts(progress, school))
    filled = with_minimum_value(fill_attempts(named), school)
    return _finish(filled.drop("minimumEvaluationId").distinct(), school, ordered)


def progress_report_individual(
    school: School,
    student_ids: Ids = None,
    subject_id: int | None = 0,
    latest: bool | None = False,
    start: DateLike = None,
    end: DateLike = None,
    strict: bool = False,
    ordered: bool | None = None,
    maintained: MaintainedAttempts | None = None,
) -> DataFrame:
    """A student's own task path against the attempts.

    ``latest`` keeps the latest attempts per staff and task. ``strict`` raises on keys
    that should be unique. ``ordered`` None sorts the report of named students and
    leaves the report of all students unsorted. ``maintained`` gives the attempts in place
    of the school's table.
    """
    path = individual_path(school, student_ids, subject_id)
    facts, every, latest = _sources(school, maintained, latest, student_ids, subject_id, strict)
    first = first_presentations(every)
    ordered = sorted_by_default(ordered, student_ids)
    # Edges of further students do no harm.
    edges = school.individual_task_paths
    if not isinstance(student_ids, DataFrame):
        edges = in_scope(edges, "studentId", student_ids)
    return _report(school, edges, path, facts, first, latest, start, end, strict, ordered)


def progress_report_individual_multidate(
    school: School,
    student_ids: Ids,
    start_one: DateLike,
    end_one: DateLike,
    start_two: DateLike,
    end_two: DateLike,
    start_three: DateLike,
    end_three: DateLike,
    subject_id: int | None = 0,
    latest: bool | None = False,
    strict: bool = False,
    ordered: bool | None = None,
    maintained: MaintainedAttempts | None = None,
) -> DataFrame:
    """The individual report split in three date buckets, numbered by ``delimiter``.

    Attempts before the first start or after the third end are left out, also where
    another bucket reaches further.
    """
    path = individual_path(school, student_ids, subject_id)
    facts, every, latest = _sources(school, maintained, latest, student_ids, subject_id, strict)
    first = first_presentations(every)
    buckets = ((start_one, end_one), (start_two, end_two), (start_three, end_three))
    ordered = sorted_by_default(ordered, student_ids)
    return _bucket_report(school, path, facts, first, latest, buckets, strict, ordered)


# The students of a benchmark path are known, so their first presentations need no
# further check against the student table.
BENCHMARK_CHECKS = ("evaluations", "evaluation_types", "staff")


def progress_report_benchmark(
    school: School,
    student_ids: Ids = None,
    subject_id: int | None = 0,
    latest: bool | None = False,
    start: DateLike = None,
    end: DateLike = None,
    as_of: dt.date | None = None,
    strict: bool = False,
    ordered: bool | None = None,
    maintained: MaintainedAttempts | None = None,
) -> DataFrame:
    """The task path of a student's age group against the attempts.

    Parameters as in ``progress_report_individual``; ``as_of`` is the day that decides
    the age, today if left out.
    """
    path = benchmark_path(school, student_ids, subject_id, as_of)
    facts, every, latest = _sources(school, maintained, latest, student_ids, subject_id, strict)
    first = first_presentations(every, school, BENCHMARK_CHECKS)
    ordered = sorted_by_default(ordered, student_ids)
    edges = school.benchmark_task_paths
    return _report(school, edges, path, facts, first, latest, start, end, strict, ordered)


def progress_report_benchmark_multidate(
    school: School,
    student_ids: Ids,
    start_one: DateLike,
    end_one: DateLike,
    start_two: DateLike,
    end_two: DateLike,
    start_three: DateLike,
    end_three: DateLike,
    subject_id: int | None = 0,
    latest: bool | None = False,
    as_of: dt.date | None = None,
    strict: bool = False,
    ordered: bool | None = None,
    maintained: MaintainedAttempts | None = None,
) -> DataFrame:
    """The benchmark report split in three date buckets, numbered by ``delimiter``."""
    path = benchmark_path(school, student_ids, subject_id, as_of)
    facts, every, latest = _sources(school, maintained, latest, student_ids, subject_id, strict)
    first = first_presentations(every, school, BENCHMARK_CHECKS)
    buckets = ((start_one, end_one), (start_two, end_two), (start_three, end_three))
    ordered = sorted_by_default(ordered, student_ids)
    return _bucket_report(school, path, facts, first, latest, buckets, strict, ordered)
