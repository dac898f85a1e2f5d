"""The registered queries: every report and operator over the whole given tables."""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasktrail.checks.parameters import (
    AS_OF,
    ATTENDANCE_RANGE,
    BUCKETS,
    CLIPPED,
    LIST,
    NULL_BOUND,
    OVERLAPPING,
    RANGE,
    STAFF,
    STUDENT,
    SUBJECT,
    TAKEN_BACK,
    WIDE_BANDS,
)
from tasktrail import plans
from tasktrail.plans.table_functions import register
from tasktrail.functions.filters import in_date_range, without_year
from tasktrail.operators.attempts import ATTEMPT_KEY, LOOKUPS, first_presentations, latest_attempts
from tasktrail.operators.attendance import attendance_counts
from tasktrail.operators.bands import age_bands, grade_bands
from tasktrail.operators.keys import ATTEMPT_MOMENT, FIRST_MOMENT, PATH_STEP, key_violations
from tasktrail.operators.lookups import attach
from tasktrail.operators.maintained import MaintainedAttempts
from tasktrail.operators.paths import benchmark_path, describe_path, individual_path
from tasktrail.operators.progress import date_buckets
from tasktrail.sources.school import School
from tasktrail.sources.shared_folder import scratch, shared_folder
from tasktrail.sources.sinks import read_messages, read_stored, read_user_messages
from tasktrail.sources.tpch_school import attendance_of, derive_school, task_evaluations_of
from tasktrail.sources.versions import current
from tasktrail.streaming import FILES_PER_BATCH, alert_stream

Query = Callable[[SparkSession, str], DataFrame]

def set_shared_folder(spark: SparkSession) -> None:
    """Give a local check session that names no shared folder one that ends with it."""
    if shared_folder(spark) is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tasktrail-checks-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)


_SCHOOLS: dict[tuple[str, str], School] = {}
_STREAMS: dict[tuple[str, str, str], str] = {}
_DEFINED: dict[str, School] = {}
_MAINTAINED: dict[tuple[str, str], MaintainedAttempts] = {}


def school_of(spark: SparkSession, folder: str) -> School:
    """The derived school of a folder, once per Spark application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SCHOOLS:
        set_shared_folder(spark)
        _SCHOOLS[key] = derive_school(spark, folder)
    return _SCHOOLS[key]


def _micros(interval: str) -> Column:
    hours = F.extract(F.lit("DAY"), interval) * 24 + F.extract(F.lit("HOUR"), interval)
    minutes = hours * 60 + F.extract(F.lit("MINUTE"), interval)
    seconds = F.extract(F.lit("SECOND"), interval)
    return (minutes.cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")).cast("long")


def _with_micros(detail: DataFrame) -> DataFrame:
    """Engines hash intervals differently, so the check compares microseconds."""
    return detail.withColumn("days_micros", _micros("days")).drop("days")


def _age_bands(school: School) -> DataFrame:
    banded = age_bands(school.students, school, AS_OF)
    return banded.select("studentId", "age", "ageGroupId", "ageGroupDescription")


def _grade_bands_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Prices in cents against wide, overlapping bands with a gap."""
    bands = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, WIDE_BANDS))}").toDF(
        "rangeBottom", "rangeTop", "gradeLetter"
    )
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    marks = lines.select("l_orderkey", "l_linenumber", "l_partkey", cents)
    return grade_bands(marks, School({"report_card_grades": bands}), "cents")


def _grade_bands(school: School) -> DataFrame:
    marks = attach(
        school.task_evaluations, school.evaluations, "evaluationId", size=school.size("evaluations")
    ).select("changeId", "evaluationValue")
    return grade_bands(marks, school, "evaluationValue")


def _path_columns(path: DataFrame, school: School) -> DataFrame:
    return describe_path(path, school).drop("isRoot")


def _flat(buckets: tuple) -> tuple:
    return tuple(day for bucket in buckets for day in bucket)


def _wanted(school: School) -> DataFrame:
    """The students of a report as a table of their own: all that a teacher lists."""
    return school.staff_students.select("studentId").distinct()


def _reports() -> dict[str, Callable[[School], DataFrame]]:
    start, end = RANGE
    individual, benchmark = plans.progress_report_individual, plans.progress_report_benchmark
    individual_buckets = plans.progress_report_individual_multidate
    benchmark_buckets = plans.progress_report_benchmark_multidate
    flat = _flat(BUCKETS)
    return {
        "report_card_all": plans.report_card,
        "report_card_dated": partial(plans.report_card, start=start, end=end),
        "report_card_one": lambda s: plans.report_card(s, STUDENT),
        "report_card_list": lambda s: plans.report_card(s, LIST, start, end),
        "report_card_frame": lambda s: plans.report_card(s, _wanted(s)),
        "student_attendance_one": lambda s: plans.report_student_attendance(s, STUDENT, as_of=AS_OF),
        "task_detail_dated": lambda s: _with_micros(
            plans.task_detail(s, start=start, end=end, as_of=AS_OF)
        ),
        "task_detail_latest_dated": lambda s: _with_micros(
            plans.task_detail_latest(s, start=start, end=end, as_of=AS_OF)
        ),
        "task_detail_staff_subject": lambda s: _with_micros(
            plans.task_detail(s, staff_id=STAFF, subject_id=SUBJECT, as_of=AS_OF)
        ),
        "task_detail_latest_staff_subject": lambda s: _with_micros(
            plans.task_detail_latest(s, None, STAFF, SUBJECT, as_of=AS_OF)
        ),
        "task_summary_one_staff": lambda s: plans.task_summary(s, STAFF),
        "task_summary_subject_dated": partial(
            plans.task_summary, subject_id=SUBJECT, start=start, end=end
        ),
        "progress_individual_one": lambda s: individual(s, STUDENT),
        "progress_individual_frame_latest": lambda s: individual(s, _wanted(s), latest=True),
        "progress_individual_subject": partial(individual, subject_id=SUBJECT),
        "progress_individual_to_only": partial(individual, end=end),
        "progress_individual_latest_from_only": partial(individual, latest=True, start=start),
        "progress_individual_multidate_overlapping": lambda s: individual_buckets(
            s, None, *_flat(OVERLAPPING), subject_id=SUBJECT
        ),
        "progress_individual_multidate_clipped": lambda s: individual_buckets(
            s, LIST, *_flat(CLIPPED)
        ),
        "progress_individual_multidate_null_bound": lambda s: individual_buckets(
            s, None, *_flat(NULL_BOUND)
        ),
        "progress_benchmark_one": lambda s: benchmark(s, STUDENT, as_of=AS_OF),
        "progress_benchmark_subject": partial(benchmark, subject_id=SUBJECT, as_of=AS_OF),
        "progress_benchmark_from_only": partial(benchmark, start=start, as_of=AS_OF),
        "progress_benchmark_to_only": partial(benchmark, end=end, as_of=AS_OF),
        "progress_benchmark_latest_dated": partial(
            benchmark, latest=True, start=start, end=end, as_of=AS_OF
        ),
        "progress_benchmark_multidate_overlapping": lambda s: benchmark_buckets(
            s, None, *_flat(OVERLAPPING), subject_id=SUBJECT, as_of=AS_OF
        ),
        "progress_benchmark_multidate_clipped": lambda s: benchmark_buckets(
            s, LIST, *_flat(CLIPPED), as_of=AS_OF
        ),
        "student_attendance_all": partial(plans.report_student_attendance, as_of=AS_OF),
        "student_attendance_dated": partial(
            plans.report_student_attendance,
            start=ATTENDANCE_RANGE[0],
            end=ATTENDANCE_RANGE[1],
            as_of=AS_OF,
        ),
        "task_detail_all": lambda s: _with_micros(plans.task_detail(s, as_of=AS_OF)),
        "task_detail_latest_all": lambda s: _with_micros(plans.task_detail_latest(s, as_of=AS_OF)),
        "task_summary_all": plans.task_summary,
        "task_summary_dated": partial(plans.task_summary, start=start, end=end),
        "progress_individual_all": individual,
        "progress_individual_latest": partial(individual, latest=True),
        "progress_individual_dated": partial(individual, start=start, end=end),
        "progress_individual_from_only": partial(individual, start=start),
        "progress_individual_latest_dated": partial(
            individual, latest=True, start=start, end=end, ordered=True
        ),
        "progress_individual_multidate": lambda s: individual_buckets(s, None, *flat),
        "progress_individual_multidate_latest": lambda s: individual_buckets(
            s, None, *flat, latest=True
        ),
        "progress_benchmark_all": partial(benchmark, as_of=AS_OF),
        "progress_benchmark_latest": partial(benchmark, latest=True, as_of=AS_OF),
        "progress_benchmark_dated": partial(benchmark, start=start, end=end, as_of=AS_OF),
        "progress_benchmark_multidate": lambda s: benchmark_buckets(s, None, *flat, as_of=AS_OF),
        "progress_benchmark_multidate_latest": lambda s: benchmark_buckets(
            s, None, *flat, latest=True, as_of=AS_OF
        ),
    }


def _operators() -> dict[str, Callable[[School], DataFrame]]:
    return {
        "first_presentations": lambda s: first_presentations(s.task_evaluations),
        "first_presentations_validated": lambda s: first_presentations(
            s.task_evaluations, s, LOOKUPS
        ),
        "latest_attempts": lambda s: latest_attempts(s.task_evaluations),
        "attempts_in_range": lambda s: s.task_evaluations.filter(
            in_date_range("evaluationDate", *RANGE)
        ),
        "individual_path_with_roots": lambda s: _path_columns(individual_path(s), s),
        "benchmark_path_with_roots": lambda s: _path_columns(benchmark_path(s, as_of=AS_OF), s),
        "attendance_counts": lambda s: attendance_counts(s.attendance),
        "age_bands": _age_bands,
        "date_buckets": lambda s: date_buckets(s.task_evaluations, BUCKETS),
        "grade_bands": _grade_bands,
        "attempt_key_violations": lambda s: key_violations(s.task_evaluations, ATTEMPT_MOMENT),
        "first_presentation_key_violations": lambda s: key_violations(
            first_presentations(s.task_evaluations), FIRST_MOMENT
        ),
        "path_key_violations": lambda s: key_violations(individual_path(s), PATH_STEP),
        "benchmark_path_key_violations": lambda s: key_violations(
            benchmark_path(s, as_of=AS_OF), PATH_STEP
        ),
        "latest_key_violations": lambda s: key_violations(
            latest_attempts(s.task_evaluations), (*ATTEMPT_KEY, "evaluationDate")
        ),
        "roster_key_violations": lambda s: key_violations(
            s.staff_students, ("staffId", "studentId")
        ),
    }


def _alerts() -> dict[str, Callable[[School], DataFrame]]:
    attendance, evaluations = plans.attendance_alerts, plans.evaluation_alerts
    return {
        "attendance_alert_messages": lambda s: attendance(s).messages,
        "attendance_alert_user_messages": lambda s: attendance(s).user_messages,
        "attendance_cleaned": lambda s: attendance(s).stored,
        # The same changes as a feed without ids delivers them.
        "attendance_alert_messages_unnamed": lambda s: attendance(
            s, without_year(s.attendance).drop("changeId")
        ).messages,
        "evaluation_alert_messages": lambda s: evaluations(s).messages,
        "evaluation_alert_user_messages": lambda s: evaluations(s).user_messages,
        "evaluation_cleaned": lambda s: evaluations(s).stored,
    }


def _day(day: dt.date | None) -> str:
    return "NULL" if day is None else f"DATE '{day}'"


def _functions() -> dict[str, Callable[[School], DataFrame]]:
    """The reports as statements over the SQL table functions."""

    def statement(text: str) -> Callable[[School], DataFrame]:
        def run(school: School) -> DataFrame:
            # The functions of a session are those of the school registered last.
            if _DEFINED.get("school") is not school:
                register(school, AS_OF)
                _DEFINED["school"] = school
            return school.students.sparkSession.sql(text)

        return run

    start, end = map(_day, RANGE)
    buckets, overlapping = (", ".join(map(_day, _flat(dates))) for dates in (BUCKETS, OVERLAPPING))
    first, last = map(_day, ATTENDANCE_RANGE)
    detail = (
        "* EXCEPT (days), CAST(round(extract(SECOND FROM days) * 1000000) AS BIGINT) + 60000000 * "
        "(extract(MINUTE FROM days) + 60 * (extract(HOUR FROM days) + 24 * CAST(extract(DAY FROM days) "
        "AS BIGINT))) AS days_micros"
    )
    return {
        "sql_report_card": statement(f"SELECT * FROM report_card(0, {start}, {end})"),
        "sql_student_attendance": statement(
            f"SELECT * FROM report_student_attendance(attendanceDateFrom => {first}, attendanceDateTo => {last})"
        ),
        "sql_task_detail": statement(
            f"SELECT {detail} FROM task_detail(NULL, {STAFF}, {SUBJECT})"
        ),
        "sql_task_detail_latest": statement(
            f"SELECT {detail} FROM task_detail_latest("
            f"evaluationDateFrom => {start}, evaluationDateTo => {end})"
        ),
        "sql_task_summary": statement(
            f"SELECT * FROM task_summary(subjectId => {SUBJECT}, "
            f"evaluationDateFrom => {start}, evaluationDateTo => {end})"
        ),
        "sql_progress_individual": statement(
            f"SELECT * FROM progress_report_individual(latest => TRUE, evaluationDateFrom => {start})"
        ),
        "sql_progress_individual_multidate": statement(
            f"SELECT * FROM progress_report_individual_multidate(NULL, {overlapping}, {SUBJECT})"
        ),
        "sql_progress_benchmark": statement("SELECT * FROM progress_report_benchmark()"),
        "sql_progress_benchmark_multidate": statement(
            f"SELECT * FROM progress_report_benchmark_multidate(NULL, {buckets}, latest => TRUE)"
        ),
    }


def _streamed(spark: SparkSession, folder: str, table: str) -> str:
    """Run the alert stream over a given table once; the folder of its outputs."""
    key = (spark.sparkContext.applicationId, folder, table)
    if key not in _STREAMS:
        set_shared_folder(spark)
        out = scratch(spark, "alerts")
        if out is None:
            raise ValueError("an alert stream needs spark.checkpoint.dir")
        given = "events" if table == "attendance" else "lineitem"
        rows = spark.read.parquet(f"{folder}/{given}.parquet")
        staff = spark.read.parquet(f"{folder}/supplier.parquet").count()
        reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
        # A stream reads folders or patterns: for a table that is one file the pattern is
        # its name with the last letter in brackets.
        single = rows.inputFiles()[0].endswith(f"/{given}.parquet")
        feed = reader.parquet(f"{folder}/{given}.parque[t]" if single else f"{folder}/{given}.parquet")
        if table == "attendance":
            changes = attendance_of(feed, staff)
        else:
            orders = spark.read.parquet(f"{folder}/orders.parquet")
            tasks = spark.read.parquet(f"{folder}/part.parquet").count()
            changes = task_evaluations_of(feed, orders, staff, tasks)
        alert_stream(
            changes, lambda: school_of(spark, folder), table, out, f"{out}/checkpoint"
        ).awaitTermination()
        _STREAMS[key] = out
    return _STREAMS[key]


def _streams() -> dict[str, Query]:
    def read(reader, table: str) -> Query:
        return lambda spark, folder: reader(spark, _streamed(spark, folder, table))

    return {
        "attendance_stream_messages": read(read_messages, "attendance"),
        "attendance_stream_user_messages": read(read_user_messages, "attendance"),
        "evaluation_stream_messages": read(read_messages, "task_evaluations"),
        "evaluation_stream_user_messages": read(read_user_messages, "task_evaluations"),
        "attendance_current": lambda spark, folder: current(
            spark,
            school_of(spark, folder).attendance,
            "attendance",
            _streamed(spark, folder, "attendance"),
        ),
        "evaluation_current": lambda spark, folder: current(
            spark,
            school_of(spark, folder).task_evaluations,
            "task_evaluations",
            _streamed(spark, folder, "task_evaluations"),
        ),
        "attendance_stream_stored": read(partial(read_stored, table="attendance"), "attendance"),
        "evaluation_stream_stored": read(
            partial(read_stored, table="task_evaluations"), "task_evaluations"
        ),
    }


def _maintained_of(spark: SparkSession, folder: str) -> MaintainedAttempts:
    """All attempts of a folder entered, some taken back, and given again in two batches."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MAINTAINED:
        facts = school_of(spark, folder).task_evaluations
        out = scratch(spark, "maintained")
        if out is None:
            raise ValueError("maintained tables need spark.checkpoint.dir")
        start, kind = TAKEN_BACK
        late, same = F.col("evaluationDate") >= F.lit(start), F.col("evaluationTypeId") == kind
        # Few buckets: the given tables are small.
        made = MaintainedAttempts(spark, out, buckets=8)
        made.add(0, facts)
        made.add(1, removed=facts.filter(late))
        made.add(2, facts.filter(late & ~same))
        made.add(3, facts.filter(late & same))
        _MAINTAINED[key] = made
    return _MAINTAINED[key]


def _maintained() -> dict[str, Query]:
    def with_state(report: Callable[[School, MaintainedAttempts], DataFrame]) -> Query:
        return lambda spark, folder: report(school_of(spark, folder), _maintained_of(spark, folder))

    return {
        "latest_attempts_maintained": with_state(lambda s, m: m.latest(upto=2)),
        "first_presentations_maintained": with_state(
            lambda s, m: first_presentations(m.attempts(upto=2), s, LOOKUPS)
        ),
        "progress_individual_latest_maintained": with_state(
            lambda s, m: plans.progress_report_individual(s, latest=True, maintained=m)
        ),
        "progress_benchmark_multidate_maintained": with_state(
            lambda s, m: plans.progress_report_benchmark_multidate(
                s, None, *_flat(BUCKETS), latest=True, as_of=AS_OF, maintained=m
            )
        ),
    }


def registered() -> dict[str, Query]:
    def on_school(report: Callable[[School], DataFrame]) -> Query:
        return lambda spark, folder: report(school_of(spark, folder))

    reports = _reports() | _operators() | _alerts() | _functions()
    on_tables = {"grade_bands_wide": _grade_bands_wide}
    return {name: on_school(report) for name, report in reports.items()} | on_tables | (
        _maintained() | _streams()
    )
