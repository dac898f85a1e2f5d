"""DuckDB SQL for every registered query, over the same given tables.

``PRELUDE`` derives the school tables, the builders below state each report on them.
"""

from __future__ import annotations

import datetime as dt

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
from tasktrail.sources.versions import ROW_KEYS

PRELUDE = """
WITH counts_of AS (
  SELECT (SELECT count(*) FROM supplier) AS n_staff, (SELECT count(*) FROM part) AS n_tasks),
te AS (
  SELECT o_custkey::INTEGER AS "studentId", ((o_custkey * 3 + l_suppkey % 4) % n_staff)::INTEGER AS "staffId",
    ((if(l_linenumber % 3 = 0, 0, o_custkey * 7 % n_tasks) + l_partkey % 24) % n_tasks)::INTEGER AS "taskId",
    ['NA', 'WO', 'NM', 'MA'][l_linenumber % 4 + 1] AS "evaluationId",
    CASE l_returnflag WHEN 'R' THEN 'FP' WHEN 'A' THEN 'EV' WHEN 'N' THEN 'AS' END AS "evaluationTypeId",
    l_shipdate + to_hours(l_orderkey % 24) AS "evaluationDate",
    (l_linenumber % 2)::INTEGER AS "propertyId",
    CASE WHEN l_linenumber <> 7 THEN 'note-' || l_orderkey END AS note,
    (l_linestatus = 'F' AND l_quantity >= 49) AS "flagAdministrator",
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER,
              l_shipdate::DATE) AS "changeId"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey, counts_of),
attendance AS (
  SELECT (user_id * 10 + event_id % 10)::INTEGER AS "studentId", (event_id % n_staff)::INTEGER AS "staffId",
    (ts::DATE - 10227)::TIMESTAMP AS "attendanceDate",
    CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 1 END AS "attendanceStatusId",
    event_type AS note, (event_type = 'signup' AND event_id % 10 = 0) AS "flagAdministrator",
    event_id::VARCHAR AS "changeId"
  FROM events, counts_of),
students AS (
  SELECT c_custkey::INTEGER AS "studentId", c_mktsegment AS "lastName", 'F' || (c_custkey % 40) AS "firstName",
    DATE '2005-01-01' + (c_custkey * 37 % 5000)::INTEGER AS "dateOfBirth"
  FROM customer),
staff AS (
  SELECT s_suppkey::INTEGER AS "staffId", 'T' || s_nationkey AS "lastName", s_name AS "firstName",
    s_suppkey::INTEGER AS "userId"
  FROM supplier),
staff_students AS (
  SELECT DISTINCT "staffId", "studentId" FROM te WHERE ("studentId" + "staffId") % 5 <> 0),
tasks AS (
  SELECT p_partkey::INTEGER AS "taskId", p_name || ' ' || p_partkey AS "taskName",
    p_partkey % 6 AS "subjectCategoryId", p_partkey % 5 AS "reportCardCategoryId"
  FROM part),
catalog AS (
  SELECT t.*, 'cat' || t."subjectCategoryId" AS "subjectCategoryName",
    (t."subjectCategoryId" % 3)::INTEGER AS "subjectId",
    'subject' || (t."subjectCategoryId" % 3) AS "subjectName",
    'grade' || (t."subjectCategoryId" % 3 % 2) AS "gradeLevelName",
    'area' || t."reportCardCategoryId" AS "reportCardCategoryName"
  FROM tasks t),
evaluations("evaluationId", "evaluationDescription", "evaluationValue") AS (
  VALUES ('NN', 'Not needed', 0), ('NA', 'Not attempted', 0), ('WO', 'Working on', 4),
         ('NM', 'Near mastery', 7), ('MA', 'Mastered', 10)),
evaluation_types("evaluationTypeId", "evaluationTypeDescription") AS (
  VALUES ('FP', 'First presentation'), ('EV', 'Evaluation'), ('AS', 'Assignment')),
property("propertyId", property) AS (VALUES (0, 'school'), (1, 'home')),
age_groups("ageGroupId", lower, upper, "ageGroupDescription") AS (
  VALUES (1, 5, 10, 'five to nine'), (2, 10, 15, 'ten to fourteen'), (3, 15, 20, 'fifteen up')),
grades("rangeBottom", "rangeTop", "gradeLetter") AS (
  VALUES (0, 3, 'D'), (4, 5, 'C'), (7, 8, 'B'), (9, 10, 'A')),
users AS (
  SELECT n_nationkey::INTEGER AS "userId", CASE WHEN n_nationkey % 5 = 0 THEN 'A' ELSE 'T' END AS "userType"
  FROM nation),
steps AS (SELECT t::INTEGER AS t FROM range(2, 24) r(t) WHERE t % 7 <> 0),
individual_edges AS (
  SELECT "studentId", (("studentId" * 7 % n_tasks + t - 2) % n_tasks)::INTEGER AS "prerequisiteTaskId",
    (("studentId" * 7 % n_tasks + t) % n_tasks)::INTEGER AS "suggestedTaskId", t + 30 AS days, 'MA' AS minimum
  FROM students, steps, counts_of WHERE (t + "studentId") % 3 <> 0),
benchmark_edges AS (
  SELECT "ageGroupId", t - 2 AS "prerequisiteTaskId", t AS "suggestedTaskId", t + 30 AS days, 'MA' AS minimum
  FROM age_groups, steps WHERE (t + "ageGroupId") % 3 <> 0)
"""


def _name(alias: str) -> str:
    return f"""{alias}."lastName" || ', ' || {alias}."firstName\""""


def _date(day: dt.date | None) -> str:
    return f"DATE '{day.isoformat()}'" if day else "NULL"


def _age(as_of: dt.date = AS_OF) -> str:
    return f"""date_part('year', age({_date(as_of)}::TIMESTAMP, "dateOfBirth"::TIMESTAMP))"""


def _between(column: str, start: dt.date | None, end: dt.date | None) -> str:
    bounds = [f"{column} IS NOT NULL"]
    if start:
        bounds.append(f"{column} >= {_date(start)}::TIMESTAMP")
    if end:
        bounds.append(f"{column} <= {_date(end)}::TIMESTAMP")
    return " AND ".join(bounds)


LATEST = """(
  SELECT * EXCLUDE (last_date) FROM (
    SELECT *, max("evaluationDate") OVER (PARTITION BY "staffId", "studentId", "taskId") AS last_date
    FROM te)
  WHERE "evaluationDate" = last_date AND "staffId" IS NOT NULL AND "studentId" IS NOT NULL
    AND "taskId" IS NOT NULL)"""


# The attempts that are left after the second batch of changes.
LEFT = f"""(
  SELECT "studentId", "staffId", "taskId", "evaluationId", "evaluationTypeId", "evaluationDate" FROM te
  WHERE ("evaluationDate" >= DATE '{TAKEN_BACK[0]}' AND "evaluationTypeId" = '{TAKEN_BACK[1]}') IS NOT TRUE)"""

ONE = f"= {STUDENT}"
SEVERAL = f"IN {LIST}"
OF_FRAME = f'IN ({PRELUDE} SELECT "studentId" FROM staff_students)'


def _of_students(statement: str, scope: str, column: str = "studentId") -> str:
    """A report cut to some students; only for reports whose rows name one student."""
    return f"""SELECT * FROM ({statement}) WHERE "{column}" {scope}"""


def report_card(start=None, end=None, students="") -> str:
    scope = f'AND e."studentId" {students}' if students else ""
    return PRELUDE + f""", means AS (
      SELECT {_name("s")} AS student, {_name("f")} AS teacher, c."reportCardCategoryName",
        c."subjectId", c."subjectName", round(avg(v."evaluationValue")) AS task_average
      FROM te e JOIN evaluations v USING ("evaluationId") JOIN catalog c USING ("taskId")
        JOIN students s USING ("studentId") JOIN staff f USING ("staffId")
      WHERE e."evaluationTypeId" = 'EV' AND {_between('e."evaluationDate"', start, end)} {scope}
      GROUP BY ALL)
    SELECT student, teacher, "subjectName", "reportCardCategoryName",
      task_average, "rangeBottom", "rangeTop", "gradeLetter" AS "letterGrade"
    FROM means JOIN grades ON task_average BETWEEN "rangeBottom" AND "rangeTop"
    """


def attendance_counts(start=None, end=None) -> str:
    return f"""
      SELECT "studentId", count(*) FILTER ("attendanceStatusId" = 2)::INTEGER AS "absentCount",
        count(*) FILTER ("attendanceStatusId" = 3)::INTEGER AS "lateCount"
      FROM attendance WHERE {_between('"attendanceDate"', start, end)}
      GROUP BY "studentId"
      HAVING "absentCount" > 0 AND "lateCount" > 0"""


def student_attendance(start=None, end=None) -> str:
    return PRELUDE + f"""
    SELECT "absentCount", "lateCount", {_age()}::DOUBLE AS age, {_name("s")} AS student, "studentId"
    FROM ({attendance_counts(start, end)}) JOIN students s USING ("studentId")
    """


DETAIL_COLUMNS = (
    'teacher, age, student, "gradeLevelName", "subjectName", "taskName", "evaluationDescription", '
    '"evaluationValue", "evaluationDate", days_micros, property, "lateCount", "absentCount", '
    '"evaluationTypeDescription", "studentId", "staffId", "subjectId", "taskId"'
)


def task_detail(latest=False, start=None, end=None, staff_id=0, subject_id=0) -> str:
    staff = f'AND e."staffId" = {staff_id}' if staff_id else ""
    subject = f'AND c."subjectId" = {subject_id}' if subject_id else ""
    return PRELUDE + f""", counts AS ({attendance_counts(start, end)}), detail AS (
      SELECT {_name("f")} AS teacher, {_age()}::DOUBLE AS age, {_name("s")} AS student,
        c.*, v.*, e.*, p.property, "lateCount", "absentCount", "evaluationTypeDescription",
        epoch_us("evaluationDate") - epoch_us(TIMESTAMP '1900-01-01') AS days_micros
      FROM {LATEST if latest else "te"} e JOIN staff f ON f."staffId" = e."staffId"
        JOIN students s ON s."studentId" = e."studentId"
        JOIN catalog c ON c."taskId" = e."taskId"
        JOIN evaluations v ON v."evaluationId" = e."evaluationId"
        JOIN property p ON p."propertyId" = e."propertyId"
        JOIN evaluation_types y ON y."evaluationTypeId" = e."evaluationTypeId"
        JOIN counts n ON n."studentId" = e."studentId"
      WHERE {_between('"evaluationDate"', start, end)} {staff} {subject})
    SELECT {DETAIL_COLUMNS} FROM detail
    """


def task_summary(start=None, end=None, staff_id=None, subject_id=0) -> str:
    staff = f'AND e."staffId" = {staff_id}' if staff_id is not None else ""
    subject = f'AND c."subjectId" = {subject_id}' if subject_id else ""
    return PRELUDE + f"""
    SELECT {_name("f")} AS teacher, c."gradeLevelName", c."subjectName", c."taskName",
      avg(v."evaluationValue") AS "evaluationAverage", f."staffId", c."subjectId"
    FROM {LATEST} e JOIN evaluations v USING ("evaluationId") JOIN staff f USING ("staffId")
      JOIN catalog c USING ("taskId") JOIN students s USING ("studentId")
      JOIN staff_students r ON r."staffId" = e."staffId" AND r."studentId" = e."studentId"
    WHERE {_between('"evaluationDate"', start, end)} {staff} {subject}
    GROUP BY ALL
    """


def _path(kind: str, subject_id: int) -> str:
    """CTE ``path``: the named steps of each student, edges and virtual roots.

    Edges and candidate roots form one set; a window then drops the candidates at
    tasks that an edge of the same student suggests.
    """
    subject = f"""WHERE "subjectId" = {subject_id}""" if subject_id else ""
    if kind == "individual":
        edges = """SELECT NULL AS age, NULL AS "ageGroupDescription", i.* FROM individual_edges i"""
        root_days = "days"
    else:
        edges = f"""SELECT a.age, g."ageGroupDescription", a."studentId", b.* EXCLUDE ("ageGroupId")
          FROM (SELECT "studentId", {_age()}::INTEGER AS age FROM students) a
            JOIN age_groups g ON a.age BETWEEN g.lower AND g.upper - 1
            JOIN benchmark_edges b USING ("ageGroupId")"""
        root_days = "1"
    return f""", edges AS ({edges}),
    listed AS (SELECT * FROM catalog {subject}),
    candidates AS (
      SELECT age, "ageGroupDescription", "studentId", "prerequisiteTaskId", "suggestedTaskId", days,
        minimum, false AS root
      FROM edges
      WHERE "suggestedTaskId" IN (SELECT "taskId" FROM listed)
        AND "prerequisiteTaskId" IN (SELECT "taskId" FROM tasks)
        AND minimum IN (SELECT "evaluationId" FROM evaluations)
      UNION ALL
      SELECT age, "ageGroupDescription", "studentId", "prerequisiteTaskId", "prerequisiteTaskId",
        {root_days}, 'NN', true
      FROM edges SEMI JOIN listed ON "taskId" = "prerequisiteTaskId"),
    walk AS (
      SELECT DISTINCT * FROM candidates
      QUALIFY NOT root OR bool_and(root) OVER (PARTITION BY "studentId", "suggestedTaskId")),
    path AS (
      SELECT s.*, c."taskName", c."subjectCategoryName", c."subjectName", c."gradeLevelName",
        if(root, 0, v."evaluationValue") AS "minimumEvaluationValue",
        if(root, 'NA', q."taskName") AS "prerequisiteTaskName"
      FROM walk s JOIN listed c ON c."taskId" = s."suggestedTaskId"
        JOIN tasks q ON q."taskId" = s."prerequisiteTaskId"
        LEFT JOIN evaluations v ON v."evaluationId" = s.minimum)"""


def _first(kind: str) -> str:
    checks = ""
    if kind == "benchmark":
        checks = """AND "evaluationId" IN (SELECT "evaluationId" FROM evaluations)
          AND "evaluationTypeId" IN (SELECT "evaluationTypeId" FROM evaluation_types)
          AND "staffId" IN (SELECT "staffId" FROM staff)
          AND "studentId" IN (SELECT "studentId" FROM students)"""
    return f"""SELECT "studentId", "staffId", "taskId", "evaluationDate" AS "firstPresentationDate",
      "evaluationTypeId" FROM te WHERE "evaluationTypeId" = 'FP' {checks}"""


def _progress_tables(kind: str, latest: bool, start, end, subject_id: int) -> str:
    """CTEs ``path`` and ``done``: the attempts with their names and starts."""
    return PRELUDE + _path(kind, subject_id) + f""", first AS ({_first(kind)}), attempts AS (
      SELECT * FROM {LATEST if latest else "te"} t WHERE {_between('"evaluationDate"', start, end)}),
    done AS (
      SELECT a."studentId", a."taskId", a."taskId" AS "suggestedTaskId", a."evaluationDate",
        b."firstPresentationDate", {_name("f")} AS teacher, {_name("s")} AS student,
        "evaluationDescription", "evaluationTypeDescription", "evaluationValue"
      FROM attempts a LEFT JOIN first b USING ("taskId", "studentId", "staffId")
        LEFT JOIN staff f USING ("staffId") LEFT JOIN students s USING ("studentId")
        LEFT JOIN evaluations v USING ("evaluationId")
        LEFT JOIN evaluation_types y ON y."evaluationTypeId" = a."evaluationTypeId")
    """


def _filled(columns: str, rows: str) -> str:
    """The report columns over ``rows``, which join ``path`` p and ``done`` d."""
    missing = "TIMESTAMP '1900-01-01'"
    return f"""
    SELECT {columns} "minimumEvaluationValue", "prerequisiteTaskName", "taskName", "subjectCategoryName",
      "subjectName", "gradeLevelName", "studentId", "prerequisiteTaskId", "suggestedTaskId",
      days::INTEGER AS "recommededDaysToComplete", "taskId", teacher, student, "evaluationDescription",
      "evaluationTypeDescription", ended AS "evaluationDate", "evaluationValue",
      started AS "firstPresentationDate", spent AS "daysToComplete",
      days::INTEGER - spent AS "differenceDaysToComplete"
    FROM (
      SELECT *, round_even((epoch(ended) - round_even(epoch(started), 0)) / 86400, 0)::INTEGER AS spent
      FROM (
        SELECT {columns} p.*, ifnull(d."taskId", 0) AS "taskId", ifnull(teacher, '(incomplete)') AS teacher,
          ifnull(student, '(incomplete)') AS student,
          ifnull("evaluationDescription", '(incomplete)') AS "evaluationDescription",
          ifnull("evaluationTypeDescription", '(incomplete)') AS "evaluationTypeDescription",
          ifnull("evaluationValue", 0) AS "evaluationValue",
          ifnull("evaluationDate", {missing}) AS ended,
          ifnull("firstPresentationDate", {missing}) AS started
        FROM {rows}))"""


def progress(kind: str, latest=False, start=None, end=None, subject_id=0) -> str:
    join = "JOIN" if start and end else "LEFT JOIN"
    return _progress_tables(kind, latest, start, end, subject_id) + _filled(
        "", f"""path p {join} done d USING ("studentId", "suggestedTaskId")"""
    )


def progress_multidate(kind: str, latest=False, buckets=BUCKETS, subject_id=0) -> str:
    bounds = ", ".join(
        f"({number}, {_date(start)}::TIMESTAMP, {_date(end)}::TIMESTAMP)"
        for number, (start, end) in enumerate(buckets, 1)
    )
    rows = f"""path p JOIN done d USING ("studentId", "suggestedTaskId")
      JOIN (VALUES {bounds}) b(delimiter, low, high) ON "evaluationDate" BETWEEN low AND high"""
    tables = _progress_tables(kind, latest, buckets[0][0], buckets[-1][1], subject_id)
    return f"""{tables} SELECT DISTINCT * FROM ({_filled("delimiter,", rows)})"""


def path_with_roots(kind: str) -> str:
    owner = 'age, "ageGroupDescription",' if kind == "benchmark" else ""
    return PRELUDE + _path(kind, 0) + f"""
    SELECT {owner} "studentId", "prerequisiteTaskId", "suggestedTaskId", days::INTEGER AS "daysToComplete",
      minimum AS "minimumEvaluationId", "minimumEvaluationValue", "prerequisiteTaskName", "taskName",
      "subjectCategoryName", "subjectName", "gradeLevelName"
    FROM path"""


PEOPLE = """'Teacher-' || f."lastName" || '/' || f."firstName" || ' - Student-' || s."lastName" || '/' || s."firstName" || ' - '"""


def attendance_messages() -> str:
    return PRELUDE + f"""
    SELECT 'attendance:' || "changeId" AS "messageId", f."userId" AS "senderUserId", {PEOPLE} || note AS text
    FROM attendance a LEFT JOIN staff f ON f."staffId" = a."staffId"
      LEFT JOIN students s ON s."studentId" = a."studentId"
    WHERE "flagAdministrator" """


def unnamed_messages() -> str:
    """Messages of attendance changes without ids, named by their content and a count."""
    columns = ("studentId", "staffId", "attendanceDate", "attendanceStatusId", "note", "flagAdministrator")
    told = " || ".join(
        f"""coalesce(length(CAST("{name}" AS VARCHAR)) || ':' || CAST("{name}" AS VARCHAR), '-')"""
        for name in columns
    )
    content = f"sha256({told})"
    return PRELUDE + f"""
    SELECT 'attendance:row::' || {content} || ':'
        || row_number() OVER (PARTITION BY {content}) AS "messageId",
      f."userId" AS "senderUserId", {PEOPLE} || note AS text
    FROM attendance a LEFT JOIN staff f USING ("staffId") LEFT JOIN students s USING ("studentId")
    WHERE "flagAdministrator" """


def current_rows(table: str, *keys: str) -> str:
    """The last stored version of each key; all rows come as versions in one batch."""
    columns = ", ".join(f'"{key}"' for key in keys)
    return PRELUDE + f"""
    SELECT * EXCLUDE n REPLACE (CASE WHEN "flagAdministrator" THEN false ELSE "flagAdministrator" END
      AS "flagAdministrator")
    FROM (SELECT *, row_number() OVER (
        PARTITION BY {columns} ORDER BY length("changeId") DESC, "changeId" DESC) AS n FROM {table})
    WHERE n = 1"""


def evaluation_messages() -> str:
    return PRELUDE + f"""
    SELECT 'task_evaluation:' || "changeId" AS "messageId", f."userId" AS "senderUserId",
      {PEOPLE} || 'Evaluation-' || "evaluationDescription" || '(' || "evaluationValue" || ') - '
        || "taskName" || ' - ' || note AS text
    FROM te a LEFT JOIN staff f ON f."staffId" = a."staffId"
      LEFT JOIN students s ON s."studentId" = a."studentId"
      LEFT JOIN evaluations v ON v."evaluationId" = a."evaluationId"
      LEFT JOIN tasks t ON t."taskId" = a."taskId"
    WHERE "flagAdministrator" """


def user_messages(table: str, source: str) -> str:
    return PRELUDE + f"""
    SELECT '{source}:' || "changeId" AS "messageId", "userId" AS "recipientUserId"
    FROM {table}, users WHERE "flagAdministrator" AND "userType" = 'A'"""


def stored(table: str) -> str:
    return PRELUDE + f"""
    SELECT * REPLACE (CASE WHEN "flagAdministrator" THEN false ELSE "flagAdministrator" END
      AS "flagAdministrator") FROM {table}"""


def _violations(rows: str, *keys: str) -> str:
    columns = ", ".join(f'"{key}"' for key in keys)
    present = " AND ".join(f'"{key}" IS NOT NULL' for key in keys)
    return f"""SELECT {columns}, count(*) AS copies FROM ({rows}) WHERE {present}
      GROUP BY {columns} HAVING count(*) > 1"""


def statements() -> dict[str, str]:
    return {
        "report_card_all": report_card(),
        "report_card_dated": report_card(*RANGE),
        "report_card_one": report_card(students=ONE),
        "report_card_list": report_card(*RANGE, students=SEVERAL),
        "report_card_frame": report_card(students=OF_FRAME),
        "student_attendance_one": _of_students(student_attendance(), ONE),
        "task_detail_dated": task_detail(False, *RANGE),
        "task_detail_latest_dated": task_detail(True, *RANGE),
        "task_detail_staff_subject": task_detail(staff_id=STAFF, subject_id=SUBJECT),
        "task_detail_latest_staff_subject": task_detail(True, staff_id=STAFF, subject_id=SUBJECT),
        "task_summary_one_staff": task_summary(staff_id=STAFF),
        "task_summary_subject_dated": task_summary(*RANGE, subject_id=SUBJECT),
        "progress_individual_one": _of_students(progress("individual"), ONE),
        "progress_individual_frame_latest": _of_students(progress("individual", True), OF_FRAME),
        "progress_individual_subject": progress("individual", subject_id=SUBJECT),
        "progress_individual_to_only": progress("individual", end=RANGE[1]),
        "progress_individual_latest_from_only": progress("individual", True, RANGE[0]),
        "progress_individual_multidate_overlapping": progress_multidate(
            "individual", False, OVERLAPPING, SUBJECT
        ),
        "progress_individual_multidate_clipped": _of_students(
            progress_multidate("individual", False, CLIPPED), SEVERAL
        ),
        "progress_individual_multidate_null_bound": progress_multidate(
            "individual", False, NULL_BOUND
        ),
        "progress_benchmark_one": _of_students(progress("benchmark"), ONE),
        "progress_benchmark_subject": progress("benchmark", subject_id=SUBJECT),
        "progress_benchmark_from_only": progress("benchmark", start=RANGE[0]),
        "progress_benchmark_to_only": progress("benchmark", end=RANGE[1]),
        "progress_benchmark_latest_dated": progress("benchmark", True, *RANGE),
        "progress_benchmark_multidate_overlapping": progress_multidate(
            "benchmark", False, OVERLAPPING, SUBJECT
        ),
        "progress_benchmark_multidate_clipped": _of_students(
            progress_multidate("benchmark", False, CLIPPED), SEVERAL
        ),
        "student_attendance_all": student_attendance(),
        "student_attendance_dated": student_attendance(*ATTENDANCE_RANGE),
        "task_detail_all": task_detail(),
        "task_detail_latest_all": task_detail(latest=True),
        "task_summary_all": task_summary(),
        "task_summary_dated": task_summary(*RANGE),
        "progress_individual_all": progress("individual"),
        "progress_individual_latest": progress("individual", latest=True),
        "progress_individual_dated": progress("individual", False, *RANGE),
        "progress_individual_from_only": progress("individual", start=RANGE[0]),
        "progress_individual_latest_dated": progress("individual", True, *RANGE),
        "progress_individual_multidate": progress_multidate("individual"),
        "progress_individual_multidate_latest": progress_multidate("individual", latest=True),
        "progress_benchmark_all": progress("benchmark"),
        "progress_benchmark_latest": progress("benchmark", latest=True),
        "progress_benchmark_dated": progress("benchmark", False, *RANGE),
        "progress_benchmark_multidate": progress_multidate("benchmark"),
        "progress_benchmark_multidate_latest": progress_multidate("benchmark", latest=True),
        "first_presentations": PRELUDE + _first("individual"),
        "first_presentations_validated": PRELUDE + _first("benchmark"),
        "latest_attempts": PRELUDE + f"SELECT * FROM {LATEST}",
        "latest_attempts_maintained": PRELUDE
        + f"SELECT * FROM {LATEST.replace('FROM te', f'FROM {LEFT}')}",
        "first_presentations_maintained": PRELUDE + _first("benchmark").replace("FROM te", f"FROM {LEFT}"),
        "progress_individual_latest_maintained": progress("individual", latest=True),
        "progress_benchmark_multidate_maintained": progress_multidate("benchmark", latest=True),
        "attempts_in_range": PRELUDE + f"""SELECT * FROM te
          WHERE {_between('"evaluationDate"', *RANGE)}""",
        "individual_path_with_roots": path_with_roots("individual"),
        "benchmark_path_with_roots": path_with_roots("benchmark"),
        "attendance_counts": PRELUDE + attendance_counts(),
        "age_bands": PRELUDE + f"""
          SELECT "studentId", age, "ageGroupId", "ageGroupDescription"
          FROM (SELECT "studentId", {_age()}::INTEGER AS age FROM students)
            JOIN age_groups ON age >= lower AND age < upper""",
        "date_buckets": PRELUDE + " UNION ALL ".join(
            f"""SELECT {number} AS delimiter, * FROM te
              WHERE {_between('"evaluationDate"', start, end)}"""
            for number, (start, end) in enumerate(BUCKETS, 1)
        ),
        "grade_bands": PRELUDE + """
          SELECT "changeId", "evaluationValue", "rangeBottom", "rangeTop", "gradeLetter"
          FROM te JOIN evaluations USING ("evaluationId")
            JOIN grades ON "evaluationValue" BETWEEN "rangeBottom" AND "rangeTop" """,
        "attempt_key_violations": PRELUDE
        + _violations("SELECT * FROM te", "taskId", "studentId", "evaluationDate"),
        "first_presentation_key_violations": PRELUDE
        + _violations(_first("individual"), "taskId", "studentId", "firstPresentationDate"),
        "path_key_violations": PRELUDE + _path("individual", 0)
        + _violations("SELECT * FROM path", "studentId", "suggestedTaskId"),
        "benchmark_path_key_violations": PRELUDE + _path("benchmark", 0)
        + _violations("SELECT * FROM path", "studentId", "suggestedTaskId"),
        "latest_key_violations": PRELUDE
        + _violations(f"SELECT * FROM {LATEST}", "staffId", "studentId", "taskId", "evaluationDate"),
        "roster_key_violations": PRELUDE
        + _violations("SELECT * FROM staff_students", "staffId", "studentId"),
        "grade_bands_wide": f"""
          WITH bands("rangeBottom", "rangeTop", "gradeLetter") AS (VALUES {", ".join(map(str, WIDE_BANDS))}),
          marks AS (SELECT l_orderkey, l_linenumber, l_partkey,
            round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)
          SELECT * FROM marks JOIN bands ON cents BETWEEN "rangeBottom" AND "rangeTop" """,
        "attendance_alert_messages": attendance_messages(),
        "attendance_alert_messages_unnamed": unnamed_messages(),
        "attendance_current": current_rows("attendance", *ROW_KEYS["attendance"]),
        "evaluation_current": current_rows("te", *ROW_KEYS["task_evaluations"]),
        "attendance_alert_user_messages": user_messages("attendance", "attendance"),
        "attendance_cleaned": stored("attendance"),
        "evaluation_alert_messages": evaluation_messages(),
        "evaluation_alert_user_messages": user_messages("te", "task_evaluation"),
        "evaluation_cleaned": stored("te"),
        "attendance_stream_messages": attendance_messages(),
        "attendance_stream_user_messages": user_messages("attendance", "attendance"),
        "evaluation_stream_messages": evaluation_messages(),
        "evaluation_stream_user_messages": user_messages("te", "task_evaluation"),
        "attendance_stream_stored": stored("attendance"),
        "evaluation_stream_stored": stored("te"),
        "sql_report_card": report_card(*RANGE),
        "sql_student_attendance": student_attendance(*ATTENDANCE_RANGE),
        "sql_task_detail": task_detail(staff_id=STAFF, subject_id=SUBJECT),
        "sql_task_detail_latest": task_detail(True, *RANGE),
        "sql_task_summary": task_summary(*RANGE, subject_id=SUBJECT),
        "sql_progress_individual": progress("individual", True, RANGE[0]),
        "sql_progress_individual_multidate": progress_multidate(
            "individual", False, OVERLAPPING, SUBJECT
        ),
        "sql_progress_benchmark": progress("benchmark"),
        "sql_progress_benchmark_multidate": progress_multidate("benchmark", latest=True),
    }
