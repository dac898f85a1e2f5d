"""Operators on hand-made rows, one case per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tasktrail.operators.attempts import (
    LOOKUPS,
    attempted_tasks,
    first_presentations,
    latest_attempts,
    select_attempts,
)
from tasktrail.operators.attendance import attendance_counts
from tasktrail.operators.bands import age_bands, band_blocks, grade_bands
from tasktrail.operators import paths
from tasktrail.operators.keys import PATH_STEP, DuplicateKeyError, key_violations, require_unique
from tasktrail.operators.lookups import attach, spread_join, task_catalog
from tasktrail.operators.paths import benchmark_path, describe_path, individual_path
from tasktrail.operators.progress import date_buckets
from tasktrail.sources import tpch_school
from tests.schools import ROWS, attempt, presence, rows_of, school, table
from tests.test_plans import explained

T, D = dt.datetime, dt.date


def attempts(spark, *rows):
    return table(spark, "task_evaluations", list(rows))


def test_latest_keeps_ties_and_drops_null_keys(spark):
    made = attempts(
        spark,
        attempt(mark="WO", when=T(2020, 1, 1)),
        attempt(mark="NM", when=T(2020, 2, 1)),
        attempt(mark="MA", when=T(2020, 2, 1)),
        attempt(staff=2, mark="WO", when=T(2019, 1, 1)),
        attempt(staff=None, mark="WO", when=T(2021, 1, 1)),
        attempt(task=12, when=None),
    )
    latest = latest_attempts(made).select("staffId", "evaluationId")
    assert sorted(rows_of(latest)) == [(1, "MA"), (1, "NM"), (2, "WO")]
    assert rows_of(attempted_tasks(made, latest=True)) == [(1, 11)]


def test_latest_is_found_before_the_dates_are_limited(spark):
    made = attempts(spark, attempt(when=T(2020, 1, 1)), attempt(when=T(2021, 1, 1)))
    inside = ("2020-01-01", "2020-12-31")
    assert select_attempts(made, True, *inside).count() == 0
    assert select_attempts(made, False, *inside).count() == 1
    assert select_attempts(made, None, *inside).count() == 1
    assert attempted_tasks(made, True, *inside).count() == 0
    assert attempted_tasks(made, False, *inside).count() == 1


def test_first_presentations_all_stay(spark):
    made = school(
        spark,
        task_evaluations=[
            attempt(kind="FP", when=T(2020, 1, 1)),
            attempt(kind="FP", when=T(2020, 1, 5)),
            attempt(kind="EV"),
            attempt(kind="FP", mark="??", when=T(2020, 1, 6)),
            attempt(kind="FP", staff=9, when=T(2020, 1, 7)),
            attempt(kind="FP", student=9, when=T(2020, 1, 8)),
        ],
    )
    assert first_presentations(made.task_evaluations).count() == 5
    valid = first_presentations(made.task_evaluations, made, LOOKUPS)
    assert sorted(rows_of(valid, "firstPresentationDate")) == [(T(2020, 1, 1),), (T(2020, 1, 5),)]


def test_attendance_needs_an_absence_and_a_late(spark):
    made = table(
        spark,
        "attendance",
        [
            presence(1, status=2),
            presence(1, status=2, when=T(2020, 1, 2)),
            presence(1, status=3),
            presence(2, status=2),
            presence(3, status=3),
            presence(4, status=1),
            presence(5, status=2),
            presence(5, status=3, when=T(2021, 1, 1)),
            presence(6, status=2),
            presence(6, status=3, when=None),
        ],
    )
    assert sorted(rows_of(attendance_counts(made))) == [(1, 2, 1), (5, 1, 1)]
    assert rows_of(attendance_counts(made, end="2020-12-31")) == [(1, 2, 1)]
    assert rows_of(attendance_counts(made, 5)) == [(5, 1, 1)]


def test_grade_bands_gap_and_overlap(spark):
    made = school(spark, report_card_grades=[(0, 3, "D"), (5, 8, "B"), (8, 10, "A"), (9, 7, "no"), (None, 9, "no")])
    means = spark.createDataFrame([(0.0,), (3.0,), (4.0,), (8.0,), (None,)], "task_average double")
    graded = grade_bands(means, made).select("task_average", "gradeLetter")
    assert sorted(rows_of(graded)) == [(0.0, "D"), (3.0, "D"), (8.0, "A"), (8.0, "B")]


def test_bands_of_any_width(spark):
    bands = [(0, 100_000, "wide"), (-5, -1, "below"), (-70_000, 2**31 - 1, "all"), (40_000, 40_000, "one")]
    made = school(spark, report_card_grades=bands)
    marks = [7.0, 32768.0, 40000.0, 100000.0, 100001.0, -1.0, -70000.0, -70001.0, 3e9]
    means = spark.createDataFrame([(mark,) for mark in marks], "task_average double")
    graded = grade_bands(means, made).select("task_average", "gradeLetter")
    expected = [(mark, name) for mark in marks for low, high, name in bands if low <= mark <= high]
    assert sorted(rows_of(graded)) == sorted(expected)
    few = band_blocks(made.report_card_grades, F.col("rangeBottom"), F.col("rangeTop"))
    assert few.count() < 4 * 66


def test_bands_block_by_block(spark):
    bands = [(low, high, f"{low}..{high}") for low in range(-9, 10) for high in range(low, 20)]
    made = school(spark, report_card_grades=bands)
    means = spark.createDataFrame([(float(mark),) for mark in range(-12, 23)], "task_average double")
    graded = grade_bands(means, made).select("task_average", "gradeLetter")
    expected = [(float(m), name) for m in range(-12, 23) for low, high, name in bands if low <= m <= high]
    assert sorted(rows_of(graded)) == sorted(expected)


def test_no_bands_no_rows(spark):
    made = school(spark, report_card_grades=[])
    means = spark.createDataFrame([(1.0,)], "task_average double")
    graded = grade_bands(means, made)
    assert graded.count() == 0 and "gradeLetter" in graded.columns


def test_a_start_before_the_latest_keeps_what_a_later_attempt_removes(spark):
    made = school(
        spark,
        task_evaluations=[
            attempt(task=11, when=T(2020, 1, 5)),
            attempt(task=11, when=T(2020, 9, 1)),
            attempt(task=12, when=T(2020, 1, 1)),
            attempt(task=13, when=T(2020, 2, 1)),
        ],
    )
    found = select_attempts(made.task_evaluations, True, "2020-01-03", "2020-06-30")
    assert rows_of(found, "taskId") == [(13,)]
    pairs = attempted_tasks(made.task_evaluations, True, "2020-01-03", "2020-06-30")
    assert rows_of(pairs, "taskId") == [(13,)]


def test_age_bands_are_half_open_and_may_overlap(spark):
    made = school(
        spark,
        students=[(1, "a", "a", D(2014, 1, 1)), (2, "b", "b", D(2010, 1, 1)), (3, "c", "c", None)],
        age_groups=[(1, 0, 10, "low"), (2, 10, 20, "high"), (3, 5, 11, "both"), (4, 7, 7, "none")],
    )
    banded = age_bands(made.students, made, D(2020, 1, 1)).select("studentId", "ageGroupDescription")
    assert sorted(rows_of(banded)) == [(1, "both"), (1, "low"), (2, "both"), (2, "high")]


def steps(path):
    return sorted(
        rows_of(
            path, "studentId", "prerequisiteTaskId", "suggestedTaskId", "daysToComplete",
            "minimumEvaluationId",
        )
    )


def test_roots_of_an_individual_path(spark):
    made = school(
        spark,
        individual_task_paths=[
            (1, 10, 11, 30, "MA"),
            (1, 11, 12, 20, "NM"),
            (2, 11, 12, 20, "NM"),
        ],
    )
    assert steps(individual_path(made)) == [
        (1, 10, 10, 30, "NN"),
        (1, 10, 11, 30, "MA"),
        (1, 11, 12, 20, "NM"),
        (2, 11, 11, 20, "NN"),
        (2, 11, 12, 20, "NM"),
    ]
    assert steps(individual_path(made, 2)) == [(2, 11, 11, 20, "NN"), (2, 11, 12, 20, "NM")]


def test_a_root_repeats_per_days_and_copies_merge(spark):
    made = school(
        spark,
        individual_task_paths=[
            (1, 10, 11, 30, "MA"),
            (1, 10, 11, 30, "MA"),
            (1, 10, 12, 40, "MA"),
            (1, 10, 13, 40, "MA"),
        ],
    )
    assert steps(individual_path(made)) == [
        (1, 10, 10, 30, "NN"),
        (1, 10, 10, 40, "NN"),
        (1, 10, 11, 30, "MA"),
        (1, 10, 12, 40, "MA"),
        (1, 10, 13, 40, "MA"),
    ]
    assert rows_of(key_violations(individual_path(made), ("studentId", "suggestedTaskId"))) == [
        (1, 10, 2)
    ]


def test_roots_are_relative_to_the_subject(spark):
    made = school(spark, individual_task_paths=[(1, 10, 11, 30, "MA"), (1, 11, 12, 20, "MA"), (1, 12, 13, 5, "MA")])
    # Subject 2: task 11 is of another subject, so it is no root; 12 is suggested.
    assert steps(individual_path(made, subject_id=2)) == [
        (1, 11, 12, 20, "MA"),
        (1, 12, 13, 5, "MA"),
    ]
    # Subject 1: the step to 12 is of another subject, 11 stays suggested by 10.
    assert steps(individual_path(made, subject_id=1)) == [(1, 10, 10, 30, "NN"), (1, 10, 11, 30, "MA")]


def test_unknown_ids_on_an_edge(spark):
    made = school(
        spark,
        individual_task_paths=[
            (1, 10, 11, 30, "??"),  # no such mark: no step, but its prerequisite is a root
            (1, 12, 99, 30, "MA"),  # no such task: same
            (1, 98, 13, 30, "MA"),  # no such prerequisite: neither step nor root
            (1, None, 11, 30, "MA"),
            (None, 10, 11, 30, "MA"),
        ],
    )
    assert steps(individual_path(made)) == [(1, 10, 10, 30, "NN"), (1, 12, 12, 30, "NN")]


def test_an_edge_to_itself_is_an_edge(spark):
    made = school(spark, individual_task_paths=[(1, 10, 10, 30, "MA")])
    named = describe_path(individual_path(made), made)
    assert rows_of(named, "minimumEvaluationId", "prerequisiteTaskName") == [("MA", "count")]


def test_benchmark_roots_and_overlapping_groups(spark):
    made = school(
        spark,
        students=[(1, "Ash", "Ann", D(2010, 5, 1)), (2, "Birch", "Bob", D(2004, 2, 29))],
        age_groups=[(1, 5, 15, "young"), (2, 9, 20, "old")],
        benchmark_task_paths=[(1, 10, 11, 30, "MA"), (2, 11, 12, 40, "MA"), (2, 11, 13, 50, "MA")],
    )
    path = benchmark_path(made, as_of=D(2020, 1, 1))
    # Student 1 is nine: both groups, and the first group's step suggests task 11.
    assert steps(path.filter("studentId = 1")) == [
        (1, 10, 10, 1, "NN"),
        (1, 10, 11, 30, "MA"),
        (1, 11, 12, 40, "MA"),
        (1, 11, 13, 50, "MA"),
    ]
    # Student 2 is in the second group only: task 11 is one root, with one day.
    assert steps(path.filter("studentId = 2")) == [
        (2, 11, 11, 1, "NN"),
        (2, 11, 12, 40, "MA"),
        (2, 11, 13, 50, "MA"),
    ]


def test_benchmark_steps_repeat_per_group_description(spark):
    made = school(
        spark,
        age_groups=[(1, 5, 15, "young"), (2, 5, 15, "young"), (3, 5, 15, "other")],
        benchmark_task_paths=[(group, 10, 11, 30, "MA") for group in (1, 2, 3)],
    )
    path = benchmark_path(made, 1, as_of=D(2020, 1, 1))
    assert sorted(rows_of(path, "ageGroupDescription", "suggestedTaskId")) == [
        ("other", 10),
        ("other", 11),
        ("young", 10),
        ("young", 11),
    ]


def test_described_path(spark):
    made = school(spark)
    named = describe_path(individual_path(made), made).select(
        "suggestedTaskId", "minimumEvaluationValue", "prerequisiteTaskName", "taskName",
        "subjectCategoryName", "subjectName", "gradeLevelName",
    )
    assert sorted(rows_of(named)) == [
        (10, 0, "NA", "count", "numbers", "maths", "first"),
        (11, 10, "count", "add", "numbers", "maths", "first"),
    ]


def test_buckets_repeat_and_drop_rows(spark):
    made = attempts(
        spark, *(attempt(when=T(2020, 1, day), change=str(day)) for day in (1, 5, 9, 20))
    )
    buckets = (("2020-01-01", "2020-01-05"), ("2020-01-05", "2020-01-10"), ("2020-01-15", None))
    tagged = date_buckets(made, buckets).select("delimiter", "changeId")
    assert sorted(rows_of(tagged)) == [(1, "1"), (1, "5"), (2, "5"), (2, "9")]


def test_key_violations_ignore_null_keys(spark):
    frame = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None)], "a int, b int")
    assert rows_of(key_violations(frame, ("a", "b"))) == [(1, 1, 2)]
    with pytest.raises(DuplicateKeyError, match="not unique on a, b"):
        require_unique(frame, ("a", "b"), "rows")
    require_unique(frame.limit(1), ("a", "b"), "rows")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    left = spark.range(400).select((F.col("id") % 7).alias("k"), (F.col("id") % 11).alias("v"))
    right = spark.range(10).select(((F.col("id") % 5) + 1).alias("k"), F.col("id").alias("w"))
    expected = sorted(rows_of(left.join(right, "k", how)))
    assert sorted(rows_of(spread_join(left, right, "k", how))) == expected
    assert sorted(rows_of(attach(left, right, "k", how, size=10))) == expected
    assert sorted(rows_of(attach(left, right, "k", how, size=10**9))) == expected


def test_catalog_drops_tasks_without_a_known_subject(spark):
    made = school(spark, tasks=[*ROWS["tasks"], (14, "lost", 9, 1)], grade_levels=[(1, "first")])
    assert sorted(rows_of(task_catalog(made), "taskId")) == [(10,), (11,)]
    assert sorted(rows_of(task_catalog(made, with_grades=False), "taskId")) == [(10,), (11,), (12,), (13,)]
    assert rows_of(task_catalog(made, 2), "taskId") == []


def test_students_are_dealt_before_their_path_rows_are_made(spark, monkeypatch):
    made = school(spark)
    plain = sorted(map(str, benchmark_path(made, as_of=D(2020, 1, 1)).collect()))
    monkeypatch.setattr(paths, "ROWS_PER_TASK", 2)
    assert sorted(map(str, benchmark_path(made, as_of=D(2020, 1, 1)).collect())) == plain
    dealt = benchmark_path(made, as_of=D(2020, 1, 1))
    assert "REPARTITION_BY_NUM" in explained(dealt)
    # Students meet in their part, so the many path rows are not shuffled to be counted.
    counted = explained(key_violations(dealt, PATH_STEP))
    assert counted.count("Exchange (") == explained(dealt).count("Exchange (")


def test_customers_are_dealt_before_their_edges_are_made(spark, monkeypatch):
    monkeypatch.setattr(tpch_school, "CUSTOMERS_PER_TASK", 10)
    customers = spark.range(0, 35, 1, 1).withColumnRenamed("id", "c_custkey")
    dealt = tpch_school._dealt(customers)
    assert dealt.rdd.getNumPartitions() == 4
    assert sorted(row[0] for row in dealt.collect()) == list(range(35))
