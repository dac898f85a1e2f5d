"""One key holds most of the rows: results stay whole and the joins are split."""

import contextlib
import datetime as dt
import io
import re

import pytest
from pyspark.sql import DataFrame, functions as F

from tasktrail import plans
from tasktrail.operators import lookups
from tasktrail.operators.attempts import latest_attempts
from tasktrail.operators.paths import individual_path
from tests.schools import NO_BROADCAST, rows_of, school, settings

HOT = 40_000
OTHERS = 20_000
STUDENTS = 200
SPLIT_EARLY = {
    **NO_BROADCAST,
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
}


def _attempts(spark, count: int, student, task, kind) -> DataFrame:
    number = F.col("id").cast("int")
    return spark.range(0, count, 1, 8).select(
        student(number).cast("int").alias("studentId"),
        F.lit(1).alias("staffId"),
        task(number).cast("int").alias("taskId"),
        F.when(number % 2 == 0, "MA").otherwise("WO").alias("evaluationId"),
        kind(number).alias("evaluationTypeId"),
        (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), number)).alias(
            "evaluationDate"
        ),
        F.lit(0).alias("propertyId"),
        F.lit("n").alias("note"),
        (number % 1000 == 0).alias("flagAdministrator"),
        F.col("id").cast("string").alias("changeId"),
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """Student 1 has two thirds of all attempts, all at task 11 with teacher 1."""
    hot = _attempts(
        spark, HOT, lambda n: F.lit(1), lambda n: F.lit(11), lambda n: F.when(n == 0, "FP").otherwise("EV")
    )
    others = _attempts(
        spark, OTHERS, lambda n: n % (STUDENTS - 1) + 2, lambda n: n % 4 + 10, lambda n: F.lit("EV")
    )
    ids = range(1, STUDENTS + 1)
    made = school(
        spark,
        students=[(n, "S", str(n), dt.date(2010, 1, 1)) for n in ids],
        individual_task_paths=[(n, 10, 11, 30, "MA") for n in ids],
        attendance=[(n, 1, dt.datetime(2020, 1, 1), s, "n", False, f"{n}{s}") for n in ids for s in (2, 3)],
        staff_students=[(1, n) for n in ids],
    )
    return made.replace(task_evaluations=hot.unionAll(others))


def run(frame: DataFrame) -> tuple[list, str]:
    """The result and the plan that produced it."""
    rows = frame.collect()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain()
    return rows, text.getvalue().split("== Initial Plan ==")[0]


def split_joins(plan: str) -> list[str]:
    return re.findall(r"SortMergeJoin\(skew=true\) \[([^\]]*)\]", re.sub(r"#\d+L?", "", plan))


def test_progress_is_whole_and_split(spark, skewed):
    with settings(spark, SPLIT_EARLY):
        rows, plan = run(plans.progress_report_individual(skewed))
    assert sum(row["studentId"] == 1 and row["taskId"] == 11 for row in rows) == HOT
    # Others: attempts at tasks 10 and 11 are half of them.
    assert sum(row["studentId"] > 1 and row["taskId"] > 0 for row in rows) == OTHERS // 2
    assert sum(row["taskId"] == 0 for row in rows) == 2 * STUDENTS - len(
        {(row["studentId"], row["taskId"]) for row in rows if row["taskId"]}
    )
    assert "studentId, suggestedTaskId" in split_joins(plan)
    assert "staffId, studentId, suggestedTaskId" in split_joins(plan)


def test_latest_of_a_hot_key(spark, skewed):
    with settings(spark, SPLIT_EARLY):
        latest = latest_attempts(skewed.task_evaluations)
        assert rows_of(latest.filter("studentId = 1"), "changeId") == [(str(HOT - 1),)]
        assert latest.count() == latest.select("staffId", "studentId", "taskId").distinct().count()


def test_copies_of_one_attempt_all_stay(spark, skewed):
    copies = skewed.task_evaluations.withColumn(
        "evaluationDate", F.lit("2001-01-01").cast("timestamp_ntz")
    )
    with settings(spark, SPLIT_EARLY):
        assert latest_attempts(copies).count() == HOT + OTHERS


def test_detail_of_a_hot_student(spark, skewed, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", skewed.size("students") - 1)
    with settings(spark, SPLIT_EARLY):
        rows, plan = run(plans.task_detail(skewed))
    assert len(rows) == HOT + OTHERS
    assert any(keys.startswith("studentId, _lane") for keys in split_joins(plan))


def test_summary_and_card_of_a_hot_key(spark, skewed):
    with settings(spark, SPLIT_EARLY):
        card = plans.report_card(skewed, 1).collect()
        summary = plans.task_summary(skewed).filter("taskName = 'add'").collect()
    assert [row["task_average"] for row in card] == [7.0]
    assert len(summary) == 1


def test_a_hot_student_of_paths(spark):
    """One student holds most path rows, most of them copies."""
    edges = spark.range(0, 30_000, 1, 8).select(
        F.lit(1).alias("studentId"),
        F.lit(10).alias("prerequisiteTaskId"),
        (F.col("id") % 3 + 11).cast("int").alias("suggestedTaskId"),
        F.lit(30).alias("daysToComplete"),
        F.lit("MA").alias("minimumEvaluationId"),
    )
    made = school(spark).replace(individual_task_paths=edges)
    assert individual_path(made).count() == 4
