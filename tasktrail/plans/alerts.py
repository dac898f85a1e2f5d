"""Alerts for administrators from a set of changed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tasktrail.functions.filters import without_year
from tasktrail.operators.alerts import (
    administrators,
    attendance_text,
    clear_flags,
    evaluation_text,
    fan_out,
    flagged,
    message_id,
    with_change_ids,
    with_marks,
    with_people,
)
from tasktrail.sources.school import School


@dataclass(frozen=True)
class Alerts:
    """What a set of changes leads to.

    ``messages``: one per flagged change. ``user_messages``: one per message and
    administrator. ``stored``: every change as it is stored, flags taken back.
    """

    messages: DataFrame
    user_messages: DataFrame
    stored: DataFrame


def _alerts(
    changes: DataFrame, told: DataFrame, named: DataFrame, text: Column, source: str, school: School
) -> Alerts:
    messages = named.select(
        message_id(source).alias("messageId"), "senderUserId", text.alias("text")
    )
    return Alerts(
        messages=messages,
        # The id follows from the change alone, so the fan-out skips the name lookups.
        user_messages=user_messages(told, source, school),
        stored=clear_flags(changes),
    )


def user_messages(told: DataFrame, source: str, school: School) -> DataFrame:
    """``told``: flagged changes that all have an id."""
    ids = told.select(message_id(source).alias("messageId"))
    recipients = administrators(school.users)
    return fan_out(ids, recipients, school.size_of("administrators", recipients))


def attendance_alerts(
    school: School, changes: DataFrame | None = None, origin: str = ""
) -> Alerts:
    """Alerts from changed attendance rows, by default from the whole table.

    Each row is one inserted or updated row version with a unique ``changeId``; for rows
    without one see ``with_change_ids``, which ``origin`` goes to.
    """
    changes = without_year(school.attendance) if changes is None else changes
    told = with_change_ids(flagged(changes), origin)
    named = with_people(told, school)
    return _alerts(changes, told, named, attendance_text(), "attendance", school)


def evaluation_alerts(
    school: School, changes: DataFrame | None = None, origin: str = ""
) -> Alerts:
    """Alerts from changed task evaluations, by default from the whole table."""
    changes = without_year(school.task_evaluations) if changes is None else changes
    told = with_change_ids(flagged(changes), origin)
    named = with_people(with_marks(told, school), school)
    return _alerts(changes, told, named, evaluation_text(), "task_evaluation", school)
