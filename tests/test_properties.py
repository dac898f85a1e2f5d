"""Relations between reports that hold on any data."""

import glob
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tasktrail.checks.oracle import statements
from tasktrail.checks.parameters import AS_OF, BUCKETS, RANGE, STUDENT
from tasktrail.checks.registry import registered
from tasktrail import plans
from tasktrail.operators.paths import individual_path
from tasktrail.sources.school import School
from tasktrail.sources.shared_folder import shared_folder
from tasktrail.sources.tpch_school import derive_school
from tests.conftest import FOLDER
from tests.schools import rows_of, school, settings, table

FLAT = [day for bucket in BUCKETS for day in bucket]
START, END = RANGE


def counted(frame):
    return Counter(rows_of(frame.select(*sorted(frame.columns))))


REPORTS = {
    "detail": lambda s, ids: plans.task_detail(s, ids, as_of=AS_OF),
    "latest": lambda s, ids: plans.task_detail_latest(s, ids, as_of=AS_OF),
    "individual": lambda s, ids: plans.progress_report_individual(s, ids),
    "benchmark": lambda s, ids: plans.progress_report_benchmark(s, ids, latest=True, as_of=AS_OF),
    "buckets": lambda s, ids: plans.progress_report_individual_multidate(s, ids, *FLAT),
}


@pytest.mark.parametrize("name", REPORTS)
def test_report_of_one_is_part_of_the_report_of_all(spark, derived, name):
    report = REPORTS[name]
    wanted = spark.createDataFrame([(7,), (101,)], "id int")
    whole = counted(report(derived, None).filter("studentId IN (7, 101)"))
    assert whole
    assert counted(report(derived, [7, 101])) == whole
    assert counted(report(derived, wanted)) == whole
    assert counted(report(derived, 7)) + counted(report(derived, 101)) == whole


def test_latest_detail_is_part_of_detail(derived):
    assert counted(plans.task_detail_latest(derived, 3)) <= counted(plans.task_detail(derived, 3))


def test_one_wide_bucket_is_the_dated_report(derived):
    buckets = plans.progress_report_individual_multidate(
        derived, None, START, END, None, None, START, END
    )
    one = buckets.filter("delimiter = 1").drop("delimiter")
    dated = plans.progress_report_individual(derived, start=START, end=END).distinct()
    assert counted(one) == counted(dated)
    assert buckets.filter("delimiter = 2").count() == 0


def test_bucket_counts_equal_a_plain_date_filter(derived):
    """Without first presentations and repeated attempts, rows are the attempts on the path."""
    facts = derived.task_evaluations
    unique = facts.filter("evaluationTypeId <> 'FP'").dropDuplicates(
        ["studentId", "staffId", "taskId", "evaluationDate"]
    )
    made = derived.replace(task_evaluations=unique)
    report = plans.progress_report_individual_multidate(made, None, *FLAT)
    got = dict(rows_of(report.groupBy("delimiter").count()))
    path = individual_path(made).select("studentId", F.col("suggestedTaskId").alias("taskId")).distinct()
    for number, (start, end) in enumerate(BUCKETS, 1):
        inside = unique.filter(F.col("evaluationDate").between(F.lit(start), F.lit(end)))
        assert got[number] == inside.join(path, ["studentId", "taskId"], "left_semi").count()


def test_every_prerequisite_is_suggested(derived):
    path = individual_path(derived)
    missing = path.join(
        path.select("studentId", F.col("suggestedTaskId").alias("prerequisiteTaskId")),
        ["studentId", "prerequisiteTaskId"],
        "left_anti",
    )
    assert missing.count() == 0


def test_measured_sizes(derived):
    assert derived.rows("students") == derived.students.count()
    assert derived.rows("tasks") == derived.tasks.count()


def test_school_from_files_and_its_errors(spark, tmp_path):
    made = school(spark)
    made.write(str(tmp_path))
    again = School.read(spark, str(tmp_path))
    assert rows_of(again.tasks.orderBy("taskId")) == rows_of(made.tasks.orderBy("taskId"))
    assert again.rows("users") == 4
    with pytest.raises(ValueError, match="not a school table"):
        School({"pupils": made.students})
    with pytest.raises(AttributeError):
        School({}).students
    narrow = table(spark, "tasks", [(1, "a", 1, 1)]).withColumn("taskId", F.col("taskId").cast("short"))
    assert dict(School({"tasks": narrow}).tasks.dtypes)["taskId"] == "int"


def test_written_facts_are_ordered_by_student(spark, derived, tmp_path):
    facts = School({"task_evaluations": derived.task_evaluations})
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        facts.write(str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/task_evaluations.parquet")
    ranges = (
        stored.groupBy("_year", F.col("_metadata.file_path"))
        .agg(F.min("studentId").alias("low"), F.max("studentId").alias("high"))
        .orderBy("_year", "low", "high")
        .collect()
    )
    assert len({row["_year"] for row in ranges}) > 1
    for left, right in zip(ranges, ranges[1:]):
        assert left["_year"] < right["_year"] or left["high"] <= right["low"]
    assert counted(stored.drop("_year")) == counted(derived.task_evaluations)


def test_without_a_shared_folder_nothing_is_written(spark, monkeypatch):
    from tasktrail.sources import shared_folder

    monkeypatch.setattr(shared_folder, "shared_folder", lambda session: None)
    frame = spark.range(3)
    assert shared_folder.written(frame, "numbers") is frame


def test_entry_points(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
    assert set(registered()) == set(statements())
    assert set(registered()) <= set(entry_points.queries())
    assert set(statements()) <= set(entry_points.oracle_sql())


def test_rosters_are_made_when_they_are_first_read(spark):
    def made():
        return set(glob.glob(f"{shared_folder(spark)}/staff_students-*"))

    before = made()
    derived = derive_school(spark, FOLDER)
    assert plans.progress_report_benchmark(derived, STUDENT, as_of=AS_OF).count() > 0
    assert made() == before
    listed = derived.task_evaluations.filter("(studentId + staffId) % 5 != 0")
    pairs = listed.select("staffId", "studentId").distinct()
    assert sorted(derived.staff_students.collect()) == sorted(pairs.collect())
    assert len(made() - before) == 1
    other = derived.replace(staff=derived.staff)
    assert other.rows("staff_students") == derived.rows("staff_students") == pairs.count()
    assert other.size("staff_students") == derived.size("staff_students") > 0
    assert len(made() - before) == 1
