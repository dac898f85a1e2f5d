"""The nine reports as SQL table functions: ``SELECT * FROM task_detail(101)``.

``register`` puts the tables of a school into the session as temporary views and defines one
temporary function per report, with the parameter names, order and defaults of the reports. A
function is a query with parameters: its arguments are constants when a statement is planned, so
filters on them reach the file scan, branches that they rule out are not planned at all, and the
statement around it prunes columns and adds filters of its own.

What does not depend on an argument (catalogue, paths with roots, latest attempts, grade blocks)
comes from the operators, as views. An id that is NULL means all; 0 means all for staff and
subject of the task details, the subject of the others and the student of the report card. As in
Python the report of one student (of one member of staff) is sorted and that of all is not.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasktrail.functions.constants import (
    EVALUATION,
    INCOMPLETE,
    NO_DATE,
    NO_TASK,
    NO_VALUE,
    STATUS_ABSENT,
    STATUS_LATE,
)
from tasktrail.functions.expressions import age_in_years, full_name
from tasktrail.functions.filters import YEAR
from tasktrail.operators.attempts import first_presentations, latest_attempts
from tasktrail.operators.bands import band_blocks
from tasktrail.operators.lookups import BROADCAST_BYTES, attach, task_catalog
from tasktrail.operators.paths import benchmark_path, describe_path, individual_path
from tasktrail.plans.attendance import report_student_attendance
from tasktrail.plans.progress import (
    BENCHMARK_CHECKS,
    progress_report_individual,
    progress_report_individual_multidate,
)
from tasktrail.plans.report_card import report_card
from tasktrail.plans.task_detail import task_detail
from tasktrail.plans.task_summary import task_summary
from tasktrail.sources.school import School

VIEW = "tasktrail_"
BUCKETS = ("One", "Two", "Three")

_ATTEMPT = ("studentId", "staffId", "taskId", "evaluationId", "evaluationTypeId", "evaluationDate")
_DATES = "evaluationDateFrom DATE DEFAULT NULL, evaluationDateTo DATE DEFAULT NULL"
_BUCKET_DATES = ", ".join(
    f"evaluationDateFrom{number} DATE, evaluationDateTo{number} DATE" for number in BUCKETS
)
_CHOICE = "subjectId INT DEFAULT 0, latest BOOLEAN DEFAULT FALSE"


def register(school: School, as_of: dt.date | None = None) -> None:
    """Define the views and functions in the session of the school's tables.

    ``as_of`` is the day that decides ages, the current day if left out. Measures the school's
    lookups and reads its grade bands; nothing else runs. Registering again replaces both.
    """
    spark = school.students.sparkSession
    _register_views(school, as_of)
    dated = YEAR in school.task_evaluations.columns
    nowhere = [None] * 6
    reports = {
        "report_card": (
            f"studentId INT DEFAULT 0, {_DATES}",
            report_card(school),
            _report_card(dated, _grade_lengths(school)),
        ),
        "report_student_attendance": (
            "studentId INT DEFAULT NULL, attendanceDateFrom DATE DEFAULT NULL, attendanceDateTo DATE DEFAULT NULL",
            report_student_attendance(school, as_of=as_of),
            _attendance(YEAR in school.attendance.columns),
        ),
        "task_summary": (
            f"staffId INT DEFAULT NULL, subjectId INT DEFAULT 0, {_DATES}",
            task_summary(school),
            _task_summary(dated),
        ),
    }
    detail = f"studentId INT DEFAULT NULL, staffId INT DEFAULT 0, subjectId INT DEFAULT 0, {_DATES}"
    counted = YEAR in school.attendance.columns
    for name, attempts in (("task_detail", "attempts"), ("task_detail_latest", "latest_attempts")):
        reports[name] = (
            detail,
            task_detail(school, as_of=as_of),
            _task_detail(name, attempts, dated, counted),
        )
    for kind in ("individual", "benchmark"):
        name = f"progress_report_{kind}"
        reports[name] = (
            f"studentId INT DEFAULT NULL, {_CHOICE}, {_DATES}",
            progress_report_individual(school),
            _progress(name, kind, dated),
        )
        name = f"{name}_multidate"
        reports[name] = (
            f"studentId INT, {_BUCKET_DATES}, {_CHOICE}",
            progress_report_individual_multidate(school, None, *nowhere),
            _multidate(name, kind, dated),
        )
    for name, (parameters, report, body) in reports.items():
        _define(spark, name, parameters, report, body)


def _define(spark: SparkSession, name: str, parameters: str, report: DataFrame, body: str) -> None:
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in report.schema)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}"
    )


def _register_views(school: School, as_of: dt.date | None) -> None:
    facts = school.task_evaluations
    attempts = facts.select(*_ATTEMPT, "propertyId", *([YEAR] if YEAR in facts.columns else []))

    def small(name: str, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if school.size(name) <= BROADCAST_BYTES else table

    people = school.students.select(
        "studentId",
        full_name().alias("student"),
        age_in_years("dateOfBirth", as_of).cast("double").alias("age"),
    )
    catalog = task_catalog(school)
    subject = catalog.select(F.col("taskId").alias("suggestedTaskId"), "subjectId")
    paths = {"individual": individual_path(school), "benchmark": benchmark_path(school, as_of=as_of)}
    views = {
        "attempts": attempts,
        "latest_attempts": latest_attempts(attempts),
        "attendance": school.attendance,
        "students": small("students", people),
        "staff": small("staff", school.staff.select("staffId", full_name().alias("teacher"))),
        "roster": small("staff_students", school.staff_students),
        "catalog": small("tasks", catalog),
        "card_catalog": small("tasks", task_catalog(school, with_grades=False)),
        "grade_blocks": band_blocks(
            school.report_card_grades, F.col("rangeBottom"), F.col("rangeTop")
        ),
        "individual_first": first_presentations(facts),
        "benchmark_first": first_presentations(facts, school, BENCHMARK_CHECKS),
        **{
            name: small(name, getattr(school, name))
            for name in ("evaluations", "evaluation_types", "property", "report_card_categories", "subjects")
        },
        **{
            f"{kind}_path": attach(
                describe_path(path, school), subject, "suggestedTaskId", size=school.size("tasks")
            )
            for kind, path in paths.items()
        },
    }
    for name, view in views.items():
        view.createOrReplaceTempView(f"{VIEW}{name}")


def _grade_lengths(school: School) -> str:
    """The lengths of the grade blocks as an SQL array; one NULL where there are no bands."""
    blocks = band_blocks(school.report_card_grades, F.col("rangeBottom"), F.col("rangeTop"))
    lengths = sorted(row[0] for row in blocks.select("_length").distinct().collect())
    return f"array({', '.join(map(str, lengths)) or 'CAST(NULL AS INT)'})"


def _dated(column: str, start: str, end: str, year: bool) -> str:
    """The date range of the reports; of facts in folders by year only those years are read."""
    limits = [
        f"{column} IS NOT NULL",
        f"({start} IS NULL OR {column} >= {start})",
        f"({end} IS NULL OR {column} <= {end})",
    ]
    if year:
        limits += [f"({start} IS NULL OR {YEAR} >= year({start}))", f"({end} IS NULL OR {YEAR} <= year({end}))"]
    return " AND ".join(limits)


def _evaluated(function: str, year: bool) -> str:
    return _dated("evaluationDate", f"{function}.evaluationDateFrom", f"{function}.evaluationDateTo", year)


def _of(column: str, argument: str) -> str:
    """An id that NULL leaves open."""
    return f"({argument} IS NULL OR {column} = {argument})"


def _of_or_all(column: str, argument: str) -> str:
    """An id that NULL and 0 leave open; rows without one drop out either way."""
    return f"{column} IS NOT NULL AND (coalesce({argument}, 0) = 0 OR {column} = {argument})"


def _sorted(named: str, *keys: str) -> str:
    """Sort keys that are constant, hence no sort at all, unless ``named`` holds."""
    parts = (key.partition(" ") for key in keys)
    return "ORDER BY " + ", ".join(
        f"CASE WHEN {named} THEN {column} END {how or 'ASC NULLS LAST'}" for column, _, how in parts
    )


def _report_card(year: bool, lengths: str) -> str:
    student = "nullif(report_card.studentId, 0)"
    return f"""
    SELECT student, teacher, subjectName, reportCardCategoryName, task_average, rangeBottom, rangeTop,
      gradeLetter AS letterGrade
    FROM (
      SELECT *, explode({lengths}) AS length FROM (
        SELECT student, teacher, reportCardCategoryId, reportCardCategoryName, subjectId, subjectName,
          round(try_divide(sum(total), sum(marks))) AS task_average
        FROM (
          SELECT studentId, staffId, reportCardCategoryId, subjectId,
            sum(evaluationValue) AS total, count(evaluationValue) AS marks
          FROM (
            SELECT * FROM {VIEW}attempts
            WHERE evaluationTypeId = '{EVALUATION}' AND studentId IS NOT NULL
              AND {_of("studentId", student)} AND {_evaluated("report_card", year)})
          JOIN {VIEW}evaluations USING (evaluationId)
          JOIN (SELECT taskId, reportCardCategoryId, subjectId FROM {VIEW}card_catalog) USING (taskId)
          GROUP BY studentId, staffId, reportCardCategoryId, subjectId)
        JOIN {VIEW}students USING (studentId)
        JOIN {VIEW}staff USING (staffId)
        JOIN {VIEW}report_card_categories USING (reportCardCategoryId)
        JOIN (SELECT subjectId, subjectName FROM {VIEW}subjects) USING (subjectId)
        GROUP BY student, teacher, reportCardCategoryId, reportCardCategoryName, subjectId, subjectName))
    JOIN {VIEW}grade_blocks ON _length = length AND _block = shiftright(CAST(task_average AS BIGINT), length)
    {_sorted(f"{student} IS NOT NULL", "student", "subjectName", "task_average")}"""


def _counts(function: str, start: str, end: str, year: bool) -> str:
    """Absences and lates of students who have both."""
    return f"""(
      SELECT studentId, CAST(count_if(attendanceStatusId = {STATUS_ABSENT}) AS INT) AS absentCount,
        CAST(count_if(attendanceStatusId = {STATUS_LATE}) AS INT) AS lateCount
      FROM {VIEW}attendance
      WHERE studentId IS NOT NULL AND attendanceStatusId IN ({STATUS_ABSENT}, {STATUS_LATE})
        AND {_of("studentId", f"{function}.studentId")}
        AND {_dated("attendanceDate", f"{function}.{start}", f"{function}.{end}", year)}
      GROUP BY studentId
      HAVING absentCount > 0 AND lateCount > 0)"""


def _attendance(year: bool) -> str:
    name = "report_student_attendance"
    descending = [f"{column} DESC NULLS FIRST" for column in ("absentCount", "lateCount", "age")]
    return f"""
    SELECT absentCount, lateCount, age, student, studentId
    FROM {_counts(name, "attendanceDateFrom", "attendanceDateTo", year)}
    JOIN {VIEW}students USING (studentId)
    {_sorted(f"{name}.studentId IS NOT NULL", *descending, "student", "studentId")}"""


def _task_detail(name: str, attempts: str, year: bool, counted_by_year: bool) -> str:
    # The detail of the latest attempts has no order, as in Python.
    order = _sorted(
        f"{name}.studentId IS NOT NULL",
        *("teacher", "age", "student", "gradeLevelName", "subjectName", "taskId", "evaluationDate"),
        "studentId",
    )
    return f"""
    SELECT teacher, age, student, gradeLevelName, subjectName, taskName, evaluationDescription,
      evaluationValue, evaluationDate, evaluationDate - TIMESTAMP_NTZ '{NO_DATE}' AS days, property,
      lateCount, absentCount, evaluationTypeDescription, studentId, staffId, subjectId, taskId
    FROM (
      SELECT * FROM {VIEW}{attempts}
      WHERE {_of("studentId", f"{name}.studentId")} AND {_of_or_all("staffId", f"{name}.staffId")}
        AND {_evaluated(name, year)})
    JOIN {_counts(name, "evaluationDateFrom", "evaluationDateTo", counted_by_year)} USING (studentId)
    JOIN {VIEW}students USING (studentId)
    JOIN {VIEW}staff USING (staffId)
    JOIN (SELECT * FROM {VIEW}catalog WHERE {_of_or_all("subjectId", f"{name}.subjectId")}) USING (taskId)
    JOIN {VIEW}evaluations USING (evaluationId)
    JOIN {VIEW}property USING (propertyId)
    JOIN {VIEW}evaluation_types USING (evaluationTypeId)
    {order if name == "task_detail" else ""}"""


def _task_summary(year: bool) -> str:
    name = "task_summary"
    return f"""
    SELECT teacher, gradeLevelName, subjectName, taskName,
      try_divide(sum(total), sum(marks)) AS evaluationAverage, staffId, subjectId
    FROM (
      SELECT staffId, taskId, sum(evaluationValue * listings) AS total,
        sum(CASE WHEN evaluationValue IS NOT NULL THEN listings END) AS marks
      FROM (
        SELECT * FROM {VIEW}latest_attempts
        WHERE {_of("staffId", f"{name}.staffId")} AND {_evaluated(name, year)})
      JOIN {VIEW}evaluations USING (evaluationId)
      JOIN (
        SELECT staffId, studentId, count(*) AS listings FROM {VIEW}roster
        WHERE {_of("staffId", f"{name}.staffId")} GROUP BY staffId, studentId) USING (staffId, studentId)
      LEFT SEMI JOIN {VIEW}students USING (studentId)
      GROUP BY staffId, taskId)
    JOIN {VIEW}staff USING (staffId)
    JOIN (SELECT * FROM {VIEW}catalog WHERE {_of_or_all("subjectId", f"{name}.subjectId")}) USING (taskId)
    GROUP BY teacher, gradeLevelName, subjectName, taskName, staffId, subjectId
    {_sorted(f"{name}.staffId IS NOT NULL", "teacher", "gradeLevelName", "subjectName", "taskName")}"""


def _chosen(name: str, dates: str) -> str:
    """The attempts of a progress report; the flag leaves one of the two branches."""
    columns = ", ".join(_ATTEMPT)
    student, latest = _of("studentId", f"{name}.studentId"), f"coalesce({name}.latest, FALSE)"
    return f"""
      SELECT {columns} FROM {VIEW}attempts WHERE NOT {latest} AND {student} AND {dates}
      UNION ALL
      SELECT {columns} FROM {VIEW}latest_attempts WHERE {latest} AND {student} AND {dates}"""


def _path(name: str, kind: str) -> str:
    return f"""
      SELECT * FROM {VIEW}{kind}_path
      WHERE {_of("studentId", f"{name}.studentId")} AND {_of_or_all("subjectId", f"{name}.subjectId")}"""


def _epoch(moment: str) -> str:
    return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {moment}) / 1000000)"


_STEP = """minimumEvaluationValue, prerequisiteTaskName, taskName, subjectCategoryName, subjectName,
      gradeLevelName, studentId, prerequisiteTaskId, suggestedTaskId"""


def _tried(kind: str, delimiter: str = "") -> str:
    """Path rows with each attempt of ``chosen``, named, and the days it took.

    The attempts stream through all joins, as in ``attempts_on_path``.
    """
    start = f"coalesce(firstPresentationDate, TIMESTAMP_NTZ '{NO_DATE}')"
    spent = f"CAST(rint(({_epoch('evaluationDate')} - rint({_epoch(start)})) / 86400) AS INT)"
    return f"""
      SELECT {delimiter} {_STEP}, daysToComplete AS recommededDaysToComplete, suggestedTaskId AS taskId,
        coalesce(teacher, '{INCOMPLETE}') AS teacher, coalesce(student, '{INCOMPLETE}') AS student,
        coalesce(evaluationDescription, '{INCOMPLETE}') AS evaluationDescription,
        coalesce(evaluationTypeDescription, '{INCOMPLETE}') AS evaluationTypeDescription,
        evaluationDate, coalesce(evaluationValue, {NO_VALUE}) AS evaluationValue,
        {start} AS firstPresentationDate, {spent} AS daysToComplete,
        daysToComplete - {spent} AS differenceDaysToComplete
      FROM (SELECT * EXCEPT (taskId), taskId AS suggestedTaskId FROM chosen)
      JOIN path USING (studentId, suggestedTaskId)
      LEFT JOIN (
        SELECT staffId, studentId, taskId AS suggestedTaskId, firstPresentationDate
        FROM {VIEW}{kind}_first) USING (staffId, studentId, suggestedTaskId)
      LEFT JOIN (SELECT studentId, student FROM {VIEW}students) USING (studentId)
      LEFT JOIN {VIEW}staff USING (staffId)
      LEFT JOIN {VIEW}evaluation_types USING (evaluationTypeId)
      LEFT JOIN {VIEW}evaluations USING (evaluationId)"""


_ORDER = (
    "gradeLevelName", "subjectName", "subjectCategoryName", "suggestedTaskId", "evaluationDate", "studentId",
)


def _progress(name: str, kind: str, year: bool) -> str:
    both = f"({name}.evaluationDateFrom IS NOT NULL AND {name}.evaluationDateTo IS NOT NULL)"
    return f"""
    WITH chosen AS ({_chosen(name, _evaluated(name, year))}), path AS ({_path(name, kind)}),
    progress AS (
      {_tried(kind)}
      UNION ALL
      SELECT {_STEP}, daysToComplete, {NO_TASK}, '{INCOMPLETE}', '{INCOMPLETE}', '{INCOMPLETE}',
        '{INCOMPLETE}', TIMESTAMP_NTZ '{NO_DATE}', {NO_VALUE}, TIMESTAMP_NTZ '{NO_DATE}', 0, daysToComplete
      FROM path LEFT JOIN (
        SELECT DISTINCT studentId, taskId AS suggestedTaskId, TRUE AS tried FROM chosen)
        USING (studentId, suggestedTaskId)
      WHERE tried IS NULL AND NOT {both})
    SELECT * FROM progress
    {_sorted(f"{name}.studentId IS NOT NULL", *_ORDER)}"""


def _multidate(name: str, kind: str, year: bool) -> str:
    """Bucket numbers are worked out per attempt, before any join."""
    bounds = [(f"{name}.evaluationDateFrom{one}", f"{name}.evaluationDateTo{one}") for one in BUCKETS]
    inside = [f"evaluationDate BETWEEN {start} AND {end}" for start, end in bounds]
    numbers = ", ".join(f"CASE WHEN {test} THEN {n} END" for n, test in enumerate(inside, 1))
    whole = _dated("evaluationDate", bounds[0][0], bounds[-1][1], year)
    wanted = f"{whole} AND ({' OR '.join(inside)})"
    return f"""
    WITH chosen AS (
      SELECT explode(array_compact(array({numbers}))) AS delimiter, * FROM ({_chosen(name, wanted)})),
    path AS ({_path(name, kind)}),
    progress AS (SELECT DISTINCT * FROM ({_tried(kind, "delimiter,")}))
    SELECT * FROM progress
    {_sorted(f"{name}.studentId IS NOT NULL", "delimiter", *_ORDER)}"""
