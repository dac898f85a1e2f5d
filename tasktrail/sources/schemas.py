"""Column names and types of the school tables.

Small integer ids and counts are kept as 32-bit integers: at scale they outgrow
16 bits, and ANSI casts would then fail.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    # Read here, not by Spark: its own reader of such texts needs a running session.
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    name: _struct(columns)
    for name, columns in {
        # Facts. changeId names one stored version of a row and is unique.
        "task_evaluations": (
            "studentId int, staffId int, taskId int, evaluationId string, evaluationTypeId string, "
            "evaluationDate timestamp_ntz, propertyId int, note string, flagAdministrator boolean, "
            "changeId string"
        ),
        "attendance": (
            "studentId int, staffId int, attendanceDate timestamp_ntz, attendanceStatusId int, "
            "note string, flagAdministrator boolean, changeId string"
        ),
        # Tables that grow with the number of students.
        "students": "studentId int, lastName string, firstName string, dateOfBirth date",
        "staff_students": "staffId int, studentId int",
        "individual_task_paths": (
            "studentId int, prerequisiteTaskId int, suggestedTaskId int, daysToComplete int, "
            "minimumEvaluationId string"
        ),
        # Lookups.
        "staff": "staffId int, lastName string, firstName string, userId int",
        "tasks": "taskId int, taskName string, subjectCategoryId int, reportCardCategoryId int",
        "subject_categories": "subjectCategoryId int, subjectCategoryName string, subjectId int",
        "subjects": "subjectId int, subjectName string, gradeLevelId int",
        "grade_levels": "gradeLevelId int, gradeLevelName string",
        "evaluations": "evaluationId string, evaluationDescription string, evaluationValue int",
        "evaluation_types": "evaluationTypeId string, evaluationTypeDescription string",
        "property": "propertyId int, property string",
        "age_groups": (
            "ageGroupId int, ageLowerRange int, ageUpperRange int, ageGroupDescription string"
        ),
        "benchmark_task_paths": (
            "ageGroupId int, prerequisiteTaskId int, suggestedTaskId int, daysToComplete int, "
            "minimumEvaluationId string"
        ),
        "report_card_categories": "reportCardCategoryId int, reportCardCategoryName string",
        "report_card_grades": "rangeBottom int, rangeTop int, gradeLetter string",
        "users": "userId int, userType string",
    }.items()
}

# Tables whose size is measured, so that they may be broadcast. The two facts and the
# individual paths never are.
MEASURED = tuple(
    name
    for name in TABLES
    if name not in ("task_evaluations", "attendance", "individual_task_paths")
)

# The dates by whose years the facts are written in folders.
DATED = {"task_evaluations": "evaluationDate", "attendance": "attendanceDate"}

# How the tables that grow with the number of students are ordered in files.
CLUSTERED = {
    "task_evaluations": ("studentId", "evaluationDate"),
    "attendance": ("studentId", "attendanceDate"),
    "students": ("studentId",),
    "individual_task_paths": ("studentId", "suggestedTaskId"),
}

MESSAGES = _struct("messageId string, senderUserId int, text string")
USER_MESSAGES = _struct("messageId string, recipientUserId int")
