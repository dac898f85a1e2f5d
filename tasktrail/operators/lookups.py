"""Joins against lookup tables of measured size, and the task catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasktrail.functions.filters import equals_or_all
from tasktrail.sources.school import School

# A lookup is broadcast up to this many bytes, as measured. The largest report broadcasts
# some twenty, so all of them together stay below 640 MiB.
BROADCAST_BYTES = 32 << 20

# Lanes of a spread join.
LANES = 8


def attach(
    left: DataFrame,
    lookup: DataFrame,
    on,
    how: str = "inner",
    *,
    size: int | None,
    spread: bool = False,
) -> DataFrame:
    """Join ``lookup``, which takes at most ``size`` bytes (None: unknown), to ``left``.

    A small lookup is broadcast, so ``left`` is not shuffled. A larger one is left to
    a sort-merge join; where both its sides come straight from a shuffle, adaptive
    execution splits the partition of a hot key. ``spread`` asks for a spread join
    instead, for a lookup that is itself joined or grouped on the same key.
    """
    if size is not None and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(lookup), on, how)
    return spread_join(left, lookup, on, how) if spread else left.join(lookup, on, how)


def spread_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi join that spreads each key of ``left`` over several lanes.

    For a right side with few rows per key that is itself the result of joins or
    aggregates on the same key. A plain join would reuse that partitioning, and
    adaptive execution does not split a hot key there. Every left row draws one lane
    from its content, every right row stands in all lanes, so each pair meets exactly
    once: exact for inner, left, semi and anti joins. The lane is part of the key, so
    both sides are shuffled for this join alone and can be split further.
    """
    keys = [on] if isinstance(on, str) else list(on)
    lane = F.pmod(F.xxhash64(*left.columns), F.lit(LANES)).cast("int")
    lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))
    return (
        left.withColumn("_lane", lane)
        .join(right.withColumn("_lane", lanes), [*keys, "_lane"], how)
        .drop("_lane")
    )


def _climb(
    tasks: DataFrame, school: School, subject_id: int | None, how: str, grades: DataFrame | None
) -> DataFrame:
    """Join the levels above a task one after the other, each a flat lookup."""
    categories = school.subject_categories.filter(equals_or_all("subjectId", subject_id))
    size = school.size
    found = attach(tasks, categories, "subjectCategoryId", how, size=size("subject_categories"))
    found = attach(found, school.subjects, "subjectId", how, size=size("subjects"))
    if grades is None:
        return found
    return attach(found, grades, "gradeLevelId", how, size=size("grade_levels"))


def task_catalog(
    school: School, subject_id: int | None = None, with_grades: bool = True
) -> DataFrame:
    """Tasks with category, subject and grade level; optionally of one subject.

    At most one row per task. A task whose category, subject or grade is unknown is
    not in the catalogue; ``with_grades`` false leaves the grade level out of it.
    """
    grades = school.grade_levels if with_grades else None
    grade = ["gradeLevelName"] if with_grades else []
    return _climb(school.tasks, school, subject_id, "inner", grades).select(
        "taskId",
        "taskName",
        "reportCardCategoryId",
        "subjectCategoryName",
        "subjectId",
        "subjectName",
        *grade,
    )


def task_status(school: School, subject_id: int | None = None) -> DataFrame:
    """Every task id with whether the catalogue (of one subject) lists it."""
    grades = school.grade_levels.select("gradeLevelId", F.lit(True).alias("_grade"))
    found = _climb(school.tasks, school, subject_id, "left", grades)
    return found.select("taskId", F.coalesce("_grade", F.lit(False)).alias("listed"))
