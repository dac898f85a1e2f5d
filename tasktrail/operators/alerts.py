"""Alert messages from flagged changes, and their fan-out to administrators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tasktrail.functions.constants import ADMINISTRATOR
from tasktrail.operators import lookups
from tasktrail.operators.lookups import attach
from tasktrail.sources.school import School

FLAG = "flagAdministrator"

# Bounds the copies of a message while recipients are joined.
MOST_LANES = 64


def flagged(changes: DataFrame) -> DataFrame:
    """Changes whose flag is set; a null flag counts as not set."""
    return changes.filter(F.col(FLAG))


def message_id(source: str, change_id: str = "changeId") -> Column:
    """The id of the message about one change: the same again when a change is replayed.

    Source and change id in full, so ids never collide. Changes without an id get one by
    ``with_change_ids`` first.
    """
    return F.concat(F.lit(f"{source}:"), F.col(change_id))


def with_change_ids(changes: DataFrame, origin: str = "") -> DataFrame:
    """Changes with an id each; one without is named by its content.

    ``row:<origin>:<SHA-256 of its columns>:<n>``, n counting equal rows from 1. ``origin`` tells
    sets of changes apart, such as the batches of a stream; the same set again gives the same
    ids. Equal rows meet as a count, never in a window.
    """
    if "changeId" not in changes.columns:
        changes = changes.withColumn("changeId", F.lit(None).cast("string"))
    columns = [name for name in changes.columns if name != "changeId"]
    named = F.col("changeId").isNotNull()

    def told(name: str) -> Column:
        text = F.col(name).cast("string")
        # The length in front keeps neighbouring columns apart.
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    content = F.sha2(F.concat(*(told(name) for name in columns)), 256)
    counted = changes.filter(~named).groupBy(*columns).agg(F.count("*").alias("_copies"))
    given = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    given = given.withColumn(
        "changeId", F.concat_ws(":", F.lit("row"), F.lit(origin), content, F.col("_copy"))
    )
    return changes.filter(named).unionByName(given.select(*changes.columns))


def _person(title: str, last: str, first: str) -> Column:
    return F.concat(F.lit(f"{title}-"), F.col(last), F.lit("/"), F.col(first))


def attendance_text() -> Column:
    """Teacher, student and note; null as soon as one part is unknown."""
    return F.concat(
        _person("Teacher", "teacherLast", "teacherFirst"),
        F.lit(" - "),
        _person("Student", "studentLast", "studentFirst"),
        F.lit(" - "),
        F.col("note"),
    )


def evaluation_text() -> Column:
    """As the attendance text, with mark and task before the note."""
    mark = F.concat(
        F.lit("Evaluation-"),
        F.col("evaluationDescription"),
        F.lit("("),
        F.col("evaluationValue").cast("string"),
        F.lit(")"),
    )
    return F.concat(
        _person("Teacher", "teacherLast", "teacherFirst"),
        F.lit(" - "),
        _person("Student", "studentLast", "studentFirst"),
        F.lit(" - "),
        mark,
        F.lit(" - "),
        F.col("taskName"),
        F.lit(" - "),
        F.col("note"),
    )


def with_people(changes: DataFrame, school: School) -> DataFrame:
    """Attach the names of teacher and student and the teacher's user; all optional."""
    students = school.students.select(
        "studentId",
        F.col("lastName").alias("studentLast"),
        F.col("firstName").alias("studentFirst"),
    )
    staff = school.staff.select(
        "staffId",
        F.col("lastName").alias("teacherLast"),
        F.col("firstName").alias("teacherFirst"),
        F.col("userId").alias("senderUserId"),
    )
    named = attach(changes, students, "studentId", "left", size=school.size("students"))
    return attach(named, staff, "staffId", "left", size=school.size("staff"))


def with_marks(changes: DataFrame, school: School) -> DataFrame:
    """Attach the mark and the task name of a task evaluation; both optional."""
    marked = attach(
        changes, school.evaluations, "evaluationId", "left", size=school.size("evaluations")
    )
    tasks = school.tasks.select("taskId", "taskName")
    return attach(marked, tasks, "taskId", "left", size=school.size("tasks"))


def administrators(users: DataFrame) -> DataFrame:
    return users.filter(F.col("userType") == ADMINISTRATOR).select(
        F.col("userId").alias("recipientUserId")
    )


def _lane(column: str, lanes: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(lanes)).cast("int")


def fan_out(messages: DataFrame, recipients: DataFrame, size: int) -> DataFrame:
    """One row per message and recipient; ``size``: the measured bytes of the recipients.

    Few recipients are broadcast as they are, and the messages stay where they are. Many
    are dealt to lanes by their id, and each message goes to every lane: a lane then holds
    a share of the recipients, and the rows of a lane that got too many can still be split,
    as both sides of the join are shuffled for it alone. There are as many lanes as the
    recipients fill broadcasts, so neither side is copied more often than needed.
    """
    lanes = 1 + size // lookups.BROADCAST_BYTES if lookups.BROADCAST_BYTES else MOST_LANES
    lanes = min(lanes, MOST_LANES)
    dealt = recipients.select("recipientUserId", _lane("recipientUserId", lanes).alias("_lane"))
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    # With one lane a hash of the message gives it, so that the join keeps its key.
    own = every if lanes > 1 else _lane("messageId", lanes)
    copies = messages.select("messageId", own.alias("_lane"))
    sent = attach(copies, dealt, "_lane", size=size)
    return sent.select("messageId", "recipientUserId")


def clear_flags(changes: DataFrame) -> DataFrame:
    """The rows as they are stored: a set flag is taken back, all else is unchanged."""
    return changes.withColumn(FLAG, F.when(F.col(FLAG), F.lit(False)).otherwise(F.col(FLAG)))
