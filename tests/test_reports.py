"""Reports on hand-made rows, one case per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tasktrail import plans
from tasktrail.operators import lookups
from tasktrail.operators.keys import DuplicateKeyError
from tests.schools import ROWS, attempt, presence, rows_of, school, table

T, D = dt.datetime, dt.date
AS_OF = D(2020, 1, 1)
BOTH = [presence(1, status=2), presence(1, status=3)]


# Report card


def test_report_card_rounds_halves_up_and_ignores_other_types(spark):
    made = school(
        spark,
        task_evaluations=[
            attempt(mark="WO", when=T(2020, 1, 1)),
            attempt(mark="NM", task=10, when=T(2020, 1, 2)),
            attempt(mark="MA", kind="FP"),
        ],
    )
    assert rows_of(plans.report_card(made)) == [
        ("Ash, Ann", "Oak, Olga", "maths", "Arithmetic", 6.0, 6, 8, "B")
    ]


def test_report_card_does_not_round_twice(spark):
    # 2.49996 is 2, although 2.5000 would be 3.
    made = school(
        spark,
        evaluations=[("A", "a", 0), ("B", "b", 5)],
        report_card_grades=[(0, 2, "low"), (3, 9, "high")],
        task_evaluations=[
            attempt(mark="B" if n < 9999 else "A", change=str(n), when=T(2020, 1, 1) + dt.timedelta(n))
            for n in range(20000)
        ],
    )
    assert rows_of(plans.report_card(made), "task_average", "letterGrade") == [(2.0, "low")]


def test_report_card_merges_homonyms_and_splits_subjects(spark):
    made = school(
        spark,
        students=[(1, "Ash", "Ann", None), (2, "Ash", "Ann", None)],
        task_evaluations=[
            attempt(student=1, mark="NA"),
            attempt(student=2, mark="MA"),
            attempt(student=2, task=12, mark="MA"),
        ],
    )
    card = plans.report_card(made).select("subjectName", "task_average")
    assert rows_of(card) == [("language", 10.0), ("maths", 5.0)]


def test_report_card_scope_dates_and_unknown_names(spark):
    made = school(
        spark,
        students=[(1, "Ash", None, None), (2, "Birch", "Bob", None)],
        task_evaluations=[
            attempt(student=1, mark="MA", when=T(2020, 1, 1)),
            attempt(student=2, mark="NA", when=T(2020, 1, 2, 12)),
            attempt(student=2, mark="MA", when=None),
        ],
    )
    names = lambda card: rows_of(card, "student")
    assert names(plans.report_card(made)) == [("Birch, Bob",), (None,)]
    assert names(plans.report_card(made, 0)) == [("Birch, Bob",), (None,)]
    assert names(plans.report_card(made, None, "2020-01-01", "2020-01-02")) == [(None,)]
    assert names(plans.report_card(made, 2)) == [("Birch, Bob",)]


# Attendance


def test_attendance_report_order(spark):
    made = school(
        spark,
        students=[(n, "S", name, D(2010, 1, 1)) for n, name in ((1, "b"), (2, "a"), (3, None), (4, "c"))]
        + [(5, "S", "z", None)],
        attendance=[
            presence(n, status=status, when=T(2020, 1, 1), change=f"{n}{status}")
            for n in (1, 2, 3, 5)
            for status in (2, 3)
        ]
        + [presence(4, status=2, change="x"), presence(4, status=2, when=T(2020, 2, 1)), presence(4, status=3)],
    )
    report = plans.report_student_attendance(made, as_of=AS_OF, ordered=True)
    assert report.columns == ["absentCount", "lateCount", "age", "student", "studentId"]
    # Most absences first; the unknown age counts as largest; unknown names come last.
    assert rows_of(report) == [
        (2, 1, 10.0, "S, c", 4),
        (1, 1, None, "S, z", 5),
        (1, 1, 10.0, "S, a", 2),
        (1, 1, 10.0, "S, b", 1),
        (1, 1, 10.0, None, 3),
    ]


# Task detail


def test_task_detail_row(spark):
    made = school(
        spark,
        attendance=BOTH,
        task_evaluations=[
            attempt(when=T(2020, 1, 1, 6), place=1),
            attempt(place=9),
            attempt(student=2, when=T(2020, 1, 1)),
        ],
    )
    detail = plans.task_detail(made, as_of=AS_OF)
    assert rows_of(detail) == [
        (
            "Oak, Olga", 9.0, "Ash, Ann", "first", "maths", "add", "Working", 4, T(2020, 1, 1, 6),
            dt.timedelta(days=43829, hours=6), "home", 1, 1, "Evaluation", 1, 1, 1, 11,
        )
    ]
    assert dict(detail.dtypes)["days"] == "interval day to second"


def test_task_detail_needs_absence_and_late_in_the_range(spark):
    made = school(
        spark,
        attendance=[presence(1, status=2), presence(1, status=3, when=T(2021, 1, 1))],
        task_evaluations=[attempt()],
    )
    assert plans.task_detail(made, 1).count() == 1
    assert plans.task_detail(made, 1, end="2020-06-01").count() == 0


def test_task_detail_filters_and_order(spark):
    made = school(
        spark,
        attendance=BOTH,
        task_evaluations=[
            attempt(staff=2, task=10, when=T(2020, 1, 3)),
            attempt(staff=1, task=12, when=T(2020, 1, 2)),
            attempt(staff=1, task=11, when=T(2020, 1, 2)),
            attempt(staff=1, task=11, when=T(2020, 1, 1)),
        ],
    )
    listed = rows_of(plans.task_detail(made, 1), "staffId", "taskId", "evaluationDate")
    assert listed == [
        (1, 11, T(2020, 1, 1)),
        (1, 11, T(2020, 1, 2)),
        (1, 12, T(2020, 1, 2)),
        (2, 10, T(2020, 1, 3)),
    ]
    assert plans.task_detail(made, 1, staff_id=2).count() == 1
    assert plans.task_detail(made, 1, 0, 2).count() == 1
    assert plans.task_detail(made, [1, 2], 1, 1).count() == 2
    assert plans.task_detail(made, 2).count() == 0
    latest = rows_of(plans.task_detail_latest(made, 1), "taskId", "evaluationDate")
    assert sorted(latest) == [(10, T(2020, 1, 3)), (11, T(2020, 1, 2)), (12, T(2020, 1, 2))]
    # The latest attempt at task 11 is outside the range, so the task is not shown.
    assert plans.task_detail_latest(made, 1, 1, 1, end="2020-01-01").count() == 0


# Task summary


def test_task_summary_counts_listings_and_latest_only(spark):
    made = school(
        spark,
        staff_students=[(1, 1), (1, 1), (1, 2), (1, 9)],
        task_evaluations=[
            attempt(student=1, mark="NA", when=T(2020, 1, 1)),
            attempt(student=1, mark="MA", when=T(2020, 1, 2)),
            attempt(student=2, mark="WO"),
            attempt(student=9, mark="NA"),
            attempt(student=1, staff=2, mark="NA"),
        ],
    )
    # Student 1 is listed twice with 10, student 2 once with 4; student 9 is unknown.
    assert rows_of(plans.task_summary(made, 1)) == [
        ("Oak, Olga", "first", "maths", "add", 8.0, 1, 1)
    ]
    assert plans.task_summary(made, 2).count() == 0
    assert plans.task_summary(made, 1, 2).count() == 0
    assert plans.task_summary(made, 1, 1, end="2020-01-01").first()["evaluationAverage"] == 4.0


def test_task_summary_groups_tasks_by_name(spark):
    made = school(
        spark,
        tasks=[(10, "same", 1, 1), (11, "same", 1, 1)],
        task_evaluations=[attempt(task=10, mark="NA"), attempt(task=11, mark="NM")],
    )
    assert rows_of(plans.task_summary(made), "taskName", "evaluationAverage") == [("same", 3.5)]


def test_task_summary_without_a_mark_value(spark):
    made = school(spark, evaluations=[("WO", "Working", None)], task_evaluations=[attempt()])
    assert rows_of(plans.task_summary(made), "evaluationAverage") == [(None,)]


# Progress


def progress(made, *arguments, **options):
    report = plans.progress_report_individual(made, *arguments, **options)
    return rows_of(
        report, "suggestedTaskId", "taskId", "evaluationDate", "firstPresentationDate",
        "daysToComplete", "differenceDaysToComplete",
    )


NONE = T(1900, 1, 1)
ROOT = (10, 0, NONE, NONE, 0, 30)


def test_progress_row(spark):
    made = school(
        spark,
        task_evaluations=[
            attempt(kind="FP", mark="NA", when=T(2020, 1, 1)),
            attempt(kind="EV", mark="MA", when=T(2020, 1, 11)),
        ],
    )
    report = plans.progress_report_individual(made, 1, start="2020-01-02", end="2020-12-31")
    assert rows_of(report) == [
        (
            10, "count", "add", "numbers", "maths", "first", 1, 10, 11, 30, 11, "Oak, Olga",
            "Ash, Ann", "Mastered", "Evaluation", T(2020, 1, 11), 10, T(2020, 1, 1), 10, 20,
        )
    ]


def test_untried_row_is_incomplete(spark):
    report = plans.progress_report_individual(school(spark), 1)
    assert rows_of(report)[1] == (
        10, "count", "add", "numbers", "maths", "first", 1, 10, 11, 30, 0, "(incomplete)",
        "(incomplete)", "(incomplete)", "(incomplete)", NONE, 0, NONE, 0, 30,
    )


def test_one_date_keeps_untried_rows_and_two_do_not(spark):
    made = school(spark, task_evaluations=[attempt(when=T(2020, 1, 1))])
    tried = (11, 11, T(2020, 1, 1), NONE, 43829, 30 - 43829)
    assert progress(made, 1) == [ROOT, tried]
    assert progress(made, 1, start="2020-01-01") == [ROOT, tried]
    assert progress(made, 1, end="2019-12-31") == [ROOT, (11, 0, NONE, NONE, 0, 30)]
    assert progress(made, 1, start="2020-01-01", end="2020-12-31") == [tried]
    assert progress(made, 1, start="2021-01-01", end="2021-12-31") == []


def test_first_presentations_fan_out_and_need_the_same_teacher(spark):
    made = school(
        spark,
        task_evaluations=[
            attempt(kind="FP", when=T(2020, 1, 1)),
            attempt(kind="FP", when=T(2020, 1, 3)),
            attempt(kind="EV", when=T(2020, 1, 5)),
            attempt(kind="EV", staff=2, when=T(2020, 1, 6)),
        ],
    )
    got = [row[2:4] for row in progress(made, 1, latest=True) if row[1]]
    assert sorted(got) == [
        (T(2020, 1, 5), T(2020, 1, 1)),
        (T(2020, 1, 5), T(2020, 1, 3)),
        (T(2020, 1, 6), NONE),
    ]


def test_first_presentation_with_unknown_mark(spark):
    made = school(
        spark,
        task_evaluations=[
            attempt(kind="FP", mark="??", when=T(2020, 1, 1)),
            attempt(kind="EV", when=T(2020, 1, 5)),
        ],
    )
    individual = plans.progress_report_individual(made, 1, latest=True)
    benchmark = plans.progress_report_benchmark(made, 1, latest=True, as_of=AS_OF)
    first = lambda report: rows_of(report.filter("taskId = 11"), "firstPresentationDate")
    assert first(individual) == [(T(2020, 1, 1),)]
    assert first(benchmark) == [(NONE,)]


def test_unknown_names_become_incomplete(spark):
    made = school(
        spark,
        students=[(1, "Ash", None, None)],
        task_evaluations=[attempt(staff=None, mark="??", kind="??")],
    )
    report = plans.progress_report_individual(made, 1).filter("taskId = 11")
    columns = ("teacher", "student", "evaluationDescription", "evaluationTypeDescription", "evaluationValue")
    assert rows_of(report, *columns) == [("(incomplete)",) * 4 + (0,)]


def test_student_missing_from_the_student_table(spark):
    made = school(spark, students=[], task_evaluations=[attempt()])
    report = plans.progress_report_individual(made, 1).filter("taskId = 11")
    assert rows_of(report, "studentId", "student", "teacher") == [(1, "(incomplete)", "Oak, Olga")]
    assert plans.progress_report_benchmark(made, 1, as_of=AS_OF).count() == 0


def test_benchmark_follows_the_age(spark):
    made = school(spark, task_evaluations=[attempt()])
    days = lambda as_of: rows_of(
        plans.progress_report_benchmark(made, 1, as_of=as_of),
        "suggestedTaskId", "recommededDaysToComplete", "taskId",
    )
    assert days(D(2020, 1, 1)) == [(10, 1, 0), (11, 30, 11)]
    assert days(D(2026, 1, 1)) == [(10, 1, 0), (12, 40, 0)]
    assert days(D(2040, 1, 1)) == []


def test_subject_filter(spark):
    made = school(
        spark,
        individual_task_paths=[(1, 10, 11, 30, "MA"), (1, 11, 12, 20, "MA")],
        task_evaluations=[attempt(task=12), attempt(task=11)],
    )
    assert [row[:2] for row in progress(made, 1, 2)] == [(12, 12)]
    assert [row[:2] for row in progress(made, 1, 1)] == [(10, 0), (11, 11)]


def test_strict_reports_duplicates(spark):
    twice = [attempt(change="1"), attempt(change="2")]
    assert len(progress(school(spark, task_evaluations=twice), 1)) == 3
    with pytest.raises(DuplicateKeyError, match="attempts"):
        progress(school(spark, task_evaluations=twice), 1, strict=True)
    paths = [(1, 10, 11, 30, "MA"), (1, 12, 11, 30, "MA")]
    with pytest.raises(DuplicateKeyError, match="path"):
        progress(school(spark, individual_task_paths=paths), 1, strict=True)
    assert len(progress(school(spark, task_evaluations=twice[:1]), 1, strict=True)) == 2
    # Attempts at tasks of other subjects are checked as well.
    with pytest.raises(DuplicateKeyError, match="attempts"):
        progress(school(spark, task_evaluations=twice), 1, 2, strict=True)


def test_order_of_a_report(spark):
    made = school(
        spark,
        individual_task_paths=[(1, 10, 11, 30, "MA"), (1, 10, 12, 20, "MA"), (1, 10, 13, 20, "MA")],
        task_evaluations=[
            attempt(task=11, when=T(2020, 1, 2)),
            attempt(task=11, staff=2, when=T(2020, 1, 1)),
            attempt(task=12, when=T(2019, 1, 1)),
        ],
    )
    order = rows_of(
        plans.progress_report_individual(made, 1), "gradeLevelName", "suggestedTaskId", "evaluationDate"
    )
    assert order == [
        ("first", 10, NONE),
        ("first", 10, NONE),
        ("first", 11, T(2020, 1, 1)),
        ("first", 11, T(2020, 1, 2)),
        ("second", 12, T(2019, 1, 1)),
        ("second", 13, NONE),
    ]


def buckets(made, *days, **options):
    report = plans.progress_report_individual_multidate(made, 1, *days, **options)
    return rows_of(report, "delimiter", "evaluationDate")


def test_buckets_clip_overlap_and_merge(spark):
    made = school(
        spark,
        staff=[(1, "Oak", "Olga", 1), (2, "Oak", "Olga", 2)],
        task_evaluations=[
            attempt(when=T(2020, 1, 1)),
            attempt(when=T(2020, 1, 5)),
            attempt(when=T(2020, 1, 9)),
            # The same report row by a teacher of the same name: merged within a bucket.
            attempt(staff=2, when=T(2020, 1, 9)),
        ],
    )
    one, five, nine = T(2020, 1, 1), T(2020, 1, 5), T(2020, 1, 9)
    overlapping = ("2020-01-01", "2020-01-05", "2020-01-05", "2020-01-09", "2020-01-09", "2020-01-31")
    assert buckets(made, *overlapping) == [(1, one), (1, five), (2, five), (2, nine), (3, nine)]
    # The second bucket reaches beyond the outer bounds and is clipped to them.
    clipped = ("2020-01-04", "2020-01-05", "2019-01-01", "2021-01-01", "2020-01-06", "2020-01-07")
    assert buckets(made, *clipped) == [(1, five), (2, five)]
    # A missing bound empties its bucket; a missing outer bound leaves that side open.
    missing = (None, "2020-01-05", "2020-01-01", "2020-01-05", "2020-01-06", None)
    assert buckets(made, *missing) == [(2, one), (2, five)]


def test_latest_in_buckets(spark):
    made = school(spark, task_evaluations=[attempt(when=T(2020, 1, 1)), attempt(when=T(2020, 1, 5))])
    days = ("2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07", "2020-01-08")
    assert buckets(made, *days, latest=True) == [(2, T(2020, 1, 5))]
    assert buckets(made, *days) == [(1, T(2020, 1, 1)), (2, T(2020, 1, 5))]


def test_benchmark_buckets(spark):
    made = school(spark, task_evaluations=[attempt(when=T(2020, 1, 1))])
    days = ("2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07", "2020-01-08")
    report = plans.progress_report_benchmark_multidate(made, 1, *days, as_of=AS_OF)
    assert report.columns[0] == "delimiter" and len(report.columns) == 21
    assert rows_of(report, "delimiter", "recommededDaysToComplete", "taskId") == [(1, 30, 11)]


# Alerts


def test_attendance_alerts(spark):
    made = school(
        spark,
        attendance=[
            presence(1, 1, note="sick", flag=True, change="a"),
            presence(1, 1, note=None, flag=True, change="b"),
            presence(9, 1, note="who", flag=True, change="c"),
            presence(1, 9, note="who", flag=True, change="d"),
            presence(1, 1, note="fine", flag=False, change="e"),
            presence(1, 1, note="fine", flag=None, change="f"),
        ],
    )
    alerts = plans.attendance_alerts(made)
    assert sorted(rows_of(alerts.messages), key=str) == [
        ("attendance:a", 101, "Teacher-Oak/Olga - Student-Ash/Ann - sick"),
        ("attendance:b", 101, None),
        ("attendance:c", 101, None),
        ("attendance:d", None, None),
    ]
    assert sorted(rows_of(alerts.user_messages)) == [
        (f"attendance:{change}", user) for change in "abcd" for user in (201, 202)
    ]
    assert sorted(rows_of(alerts.stored, "changeId", "flagAdministrator")) == [
        *((change, False) for change in "abcde"),
        ("f", None),
    ]


def test_evaluation_alert_text(spark):
    made = school(spark, task_evaluations=[attempt(mark="MA", note="well done", flag=True, change="x")])
    assert rows_of(plans.evaluation_alerts(made).messages) == [
        (
            "task_evaluation:x",
            101,
            "Teacher-Oak/Olga - Student-Ash/Ann - Evaluation-Mastered(10) - add - well done",
        )
    ]


def test_no_administrators(spark):
    made = school(spark, users=[(101, "T")], attendance=[presence(flag=True)])
    alerts = plans.attendance_alerts(made)
    assert alerts.messages.count() == 1 and alerts.user_messages.count() == 0


def test_alerts_of_given_changes(spark):
    made = school(spark, attendance=[presence(flag=True, change="old")])
    changes = table(spark, "attendance", [presence(flag=True, change="new")])
    assert rows_of(plans.attendance_alerts(made, changes).messages, "messageId") == [("attendance:new",)]


def test_a_large_set_of_users_is_not_broadcast(spark, monkeypatch):
    made = school(
        spark,
        users=[(n, "A") for n in range(50)],
        attendance=[presence(flag=True, change=str(n)) for n in range(20)],
    )
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 1)
    pairs = plans.attendance_alerts(made).user_messages
    assert pairs.distinct().count() == 1000 and pairs.count() == 1000
    assert pairs.agg(F.min("recipientUserId"), F.max("recipientUserId")).first() == (0, 49)


def test_standard_rows_cover_every_table():
    from tasktrail.sources.schemas import TABLES

    assert set(ROWS) == set(TABLES)
