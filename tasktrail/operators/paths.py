"""Task paths: what a student should do next, with virtual roots.

A path row says: after ``prerequisiteTaskId`` comes ``suggestedTaskId``. A task that
is only ever a prerequisite gets a virtual row of its own, a root, so that the whole
path is visible. A root takes a fixed number of days or, on individual paths, the days
of the edges it starts: different days give several rows.

Paths travel as ids; names are attached at the end, so shuffles carry integers.

A path is per *owner*: a student, or an age for the benchmark paths. All students of
one age share the same age groups, hence the same path, also where groups overlap.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tasktrail.functions.constants import (
    ROOT_BENCHMARK_DAYS,
    ROOT_MINIMUM_ID,
    ROOT_MINIMUM_VALUE,
    ROOT_PREREQUISITE_NAME,
)
from tasktrail.functions.expressions import age_in_years
from tasktrail.functions.filters import Ids, in_scope
from tasktrail.operators import lookups
from tasktrail.operators.bands import age_groups_of
from tasktrail.operators.lookups import attach, task_catalog, task_status
from tasktrail.sources.school import School

STEP = ("prerequisiteTaskId", "suggestedTaskId", "daysToComplete", "minimumEvaluationId")

TASK_NAMES = (
    "prerequisiteTaskName",
    "taskName",
    "subjectCategoryName",
    "subjectName",
    "gradeLevelName",
)

# What a row of ``task_status`` takes: two columns without text and their null marks.
STATUS_BYTES = 24

# Rows of the benchmark path that one task makes, at most.
ROWS_PER_TASK = 2_000_000


def path_steps(
    edges: DataFrame,
    school: School,
    owner: Sequence[str],
    subject_id: int | None = None,
    root_days: int | None = None,
) -> DataFrame:
    """The distinct steps that the edges of each owner may lead to, in one pass.

    An edge whose ids are all known gives itself; an edge whose prerequisite is listed
    gives a candidate root, a step of that task to itself. Copies of an edge merge
    before the shuffle. A candidate equal to an edge counts as that edge.
    """
    status, tasks = task_status(school, subject_id), STATUS_BYTES * school.rows("tasks")
    suggested = status.select(
        F.col("taskId").alias("suggestedTaskId"), F.col("listed").alias("_suggested")
    )
    prerequisite = status.select(
        F.col("taskId").alias("prerequisiteTaskId"),
        F.col("listed").alias("_prerequisite"),
    )
    minimum = school.evaluations.select(
        F.col("evaluationId").alias("minimumEvaluationId"), F.lit(True).alias("_minimum")
    )
    known = attach(edges, suggested, "suggestedTaskId", "left", size=tasks)
    known = attach(known, prerequisite, "prerequisiteTaskId", "left", size=tasks)
    known = attach(
        known, minimum, "minimumEvaluationId", "left", size=school.size("evaluations")
    )

    days = F.col("daysToComplete") if root_days is None else F.lit(root_days)
    step = F.struct(*STEP, F.lit(False).alias("isRoot"))
    root = F.struct(
        F.col("prerequisiteTaskId"),
        F.col("prerequisiteTaskId").alias("suggestedTaskId"),
        days.alias("daysToComplete"),
        F.lit(ROOT_MINIMUM_ID).alias("minimumEvaluationId"),
        F.lit(True).alias("isRoot"),
    )
    steps = F.array(
        F.when(F.col("_suggested") & F.col("_prerequisite").isNotNull() & F.col("_minimum"), step),
        F.when(F.col("_prerequisite"), root),
    )
    return (
        known.select(*owner, F.explode(steps).alias("step"))
        .filter(F.col("step").isNotNull())
        .select(*owner, "step.*")
        .groupBy(*owner, *STEP)
        .agg(F.min("isRoot").alias("isRoot"))
    )


def with_virtual_roots(steps: DataFrame, owner: str) -> DataFrame:
    """Keep every edge, and the candidate roots that no edge of the owner suggests.

    Both sides of the match are distinct by now, so no key is hot.
    """
    edges = steps.filter(~F.col("isRoot"))
    suggested = edges.select(owner, "suggestedTaskId").distinct()
    candidates = steps.filter("isRoot")
    return edges.unionByName(candidates.join(suggested, [owner, "suggestedTaskId"], "left_anti"))


def individual_path(
    school: School, student_ids: Ids = None, subject_id: int | None = None
) -> DataFrame:
    """Each student's own path with virtual roots, as ids."""
    edges = in_scope(school.individual_task_paths, "studentId", student_ids)
    edges = edges.filter(F.col("studentId").isNotNull())
    return with_virtual_roots(path_steps(edges, school, ["studentId"], subject_id), "studentId")


def path_by_age(school: School, ages: DataFrame, subject_id: int | None = None) -> DataFrame:
    """The benchmark path of each distinct ``age``, from lookup-sized tables only."""
    edges = age_groups_of(ages, school).join(school.benchmark_task_paths, "ageGroupId")
    owner = ["age", "ageGroupDescription"]
    return with_virtual_roots(
        path_steps(edges, school, owner, subject_id, root_days=ROOT_BENCHMARK_DAYS), "age"
    )


def benchmark_path(
    school: School,
    student_ids: Ids = None,
    subject_id: int | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Each student's age-group path with virtual roots, as ids."""
    students = in_scope(school.students, "studentId", student_ids)
    students = students.filter(F.col("studentId").isNotNull()).select(
        "studentId", age_in_years("dateOfBirth", as_of).alias("age")
    )
    ages = students.select("age").distinct()
    path = path_by_age(school, ages, subject_id)
    # An age meets each edge at most once as an edge and once as a root. A student has one
    # age, so a report of few students has few of them.
    everyone = school.students.select(age_in_years("dateOfBirth", as_of).alias("age")).distinct()
    size = 2 * school.size_of(f"ages {as_of}", everyone) * school.size("benchmark_task_paths")
    if student_ids is None or isinstance(student_ids, DataFrame):
        # A student takes few bytes in a file and many path rows, so files do not part them well.
        rows = 2 * school.rows("students") * school.rows("benchmark_task_paths")
        if rows > ROWS_PER_TASK:
            students = students.repartition(-(-rows // ROWS_PER_TASK), "studentId")
    return attach(students, path, "age", size=size, spread=True)


def with_minimum_value(path: DataFrame, school: School) -> DataFrame:
    """Add the mark that the minimum evaluation stands for."""
    minimums = school.evaluations.select(
        F.col("evaluationId").alias("minimumEvaluationId"), F.col("evaluationValue").alias("_minimum")
    )
    valued = attach(path, minimums, "minimumEvaluationId", "left", size=school.size("evaluations"))
    value = F.when(F.col("isRoot"), ROOT_MINIMUM_VALUE).otherwise(F.col("_minimum"))
    return valued.withColumn("minimumEvaluationValue", value).drop("_minimum")


def with_task_names(
    path: DataFrame, school: School, edges: DataFrame | None = None
) -> DataFrame:
    """Add the names of the suggested task, its category, subject and grade, and of the
    prerequisite. Every path row has a catalogued task, so no row is lost.

    ``edges``: all that the path was made of. If the tasks are too many to broadcast, the
    distinct pairs of tasks they may lead to are named, and the rows are shuffled once for both names.
    """
    if edges is None or school.size("tasks") <= lookups.BROADCAST_BYTES:
        named = _name_tasks(path, school)
    else:
        pair = ["suggestedTaskId", "prerequisiteTaskId"]
        root = F.struct(F.col(pair[1]).alias(pair[0]), pair[1])
        pairs = edges.select(F.explode(F.array(F.struct(*pair), root)).alias("pair")).select("pair.*")
        names = _name_tasks(pairs.distinct(), school).withColumnsRenamed({name: f"_{name}" for name in pair})
        # No plain equality of the prerequisites: the filter that comes with it would reach some
        # branches of the path only, which then could not share their shuffles.
        same = [F.col(pair[0]) == F.col(f"_{pair[0]}"), F.col(pair[1]).eqNullSafe(F.col(f"_{pair[1]}"))]
        named = path.join(names, same).drop(*(f"_{name}" for name in pair))
    name = F.when(F.col("isRoot"), ROOT_PREREQUISITE_NAME).otherwise(F.col("_prerequisite"))
    return named.withColumn("prerequisiteTaskName", name).drop("_prerequisite")


def _name_tasks(rows: DataFrame, school: School) -> DataFrame:
    tasks = school.size("tasks")
    catalog = task_catalog(school).select(
        F.col("taskId").alias("suggestedTaskId"),
        "taskName",
        "subjectCategoryName",
        "subjectName",
        "gradeLevelName",
    )
    prerequisites = school.tasks.select(
        F.col("taskId").alias("prerequisiteTaskId"), F.col("taskName").alias("_prerequisite")
    )
    named = attach(rows, catalog, "suggestedTaskId", size=tasks)
    return attach(named, prerequisites, "prerequisiteTaskId", "left", size=tasks)


def describe_path(path: DataFrame, school: School) -> DataFrame:
    """A path with all its names and minimum values."""
    return with_task_names(with_minimum_value(path, school), school)
