"""Ids of taken changes, repeatable batches, and facts as their stored versions leave them."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tasktrail import plans
from tasktrail.operators import lookups
from tasktrail.operators.alerts import with_change_ids
from tasktrail.plans import attendance_alerts
from tasktrail.sources import sinks
from tasktrail.sources.schemas import TABLES
from tasktrail.sources.school import School
from tasktrail.sources.sinks import read_messages, read_stored, read_user_messages
from tasktrail.sources.versions import (
    ROW_KEYS,
    compact,
    compacted,
    current,
    forget,
    merged,
    read_current,
)
from tasktrail.streaming import ledger as ledgers
from tasktrail.streaming.ledger import Ledger, _bitmaps, _places
from tests.schools import NO_BROADCAST, presence, rows_of, school, settings, table
from tests.test_plans import explained, final_plan
from tests.test_streaming import FIRST, deliver, run

T = dt.datetime


def ids_of(spark, names):
    return spark.createDataFrame([(name,) for name in names], "changeId string")


def found(frame):
    return set() if frame is None else {row[0] for row in frame.collect()}


def test_ledger_finds_exactly_what_earlier_batches_took(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgers, "RUN", 3)
    # Two buckets of two segments of which few bits stay clear: filters alone would not do.
    monkeypatch.setattr(ledgers, "BUCKETS", 2)
    monkeypatch.setattr(ledgers, "SEGMENTS", 2)
    taken = Ledger(spark, str(tmp_path / "ledger"))
    rng = random.Random(1)
    history: list[set] = []
    for batch in range(4):
        names = {f"c{rng.randrange(60_000)}" for _ in range(9_000)}
        history.append(names)
        taken.add(ids_of(spark, names), batch)
    everything = set().union(*history)
    asked = {f"c{i}" for i in range(0, 60_000, 211)}
    assert found(taken.seen(ids_of(spark, asked), 4)) == asked & everything
    # The run of the first three is one folder, and a rerun of batch 3 does not see itself.
    assert sorted(p.name for p in (tmp_path / "ledger").iterdir()) == ["0-2", "3-3"]
    assert found(taken.seen(ids_of(spark, asked), 3)) == asked & set().union(*history[:3])


def test_ledger_opens_no_bucket_without_a_repeat(spark, tmp_path):
    taken = Ledger(spark, str(tmp_path / "ledger"))
    taken.add(ids_of(spark, [f"old{i}" for i in range(500)]), 0)
    assert taken.seen(ids_of(spark, [f"new{i}" for i in range(50)]), 1) is None
    assert found(taken.seen(ids_of(spark, ["old7", "new1"]), 1)) == {"old7"}


def test_ledger_replaces_an_entry_that_was_cut_off(spark, tmp_path):
    taken = Ledger(spark, str(tmp_path / "ledger"))
    taken.add(ids_of(spark, ["a", "b"]), 0)
    (tmp_path / "ledger" / "0-0" / "filters" / "_SUCCESS").unlink()
    assert taken.seen(ids_of(spark, ["a"]), 1) is None
    taken.add(ids_of(spark, ["a", None]), 0)
    assert found(taken.seen(ids_of(spark, ["a", "b"]), 1)) == {"a"}
    assert taken.seen(ids_of(spark, []), 1) is None


def test_a_change_delivered_batches_later_is_one_alert(spark, tmp_path):
    made = school(spark)
    feed = tmp_path / "feed"
    other = [presence(2, 2, T(2021, 1, day), 2, "n", True, f"b{day}") for day in (1, 2)]
    for rows in (FIRST, other[:1], other[1:], FIRST + other):
        deliver(spark, feed, "attendance", rows)
        run(spark, made, feed, tmp_path)
    ids = sorted(row[0] for row in rows_of(read_messages(spark, str(tmp_path)), "messageId"))
    assert ids == ["attendance:a1", "attendance:b1", "attendance:b2"]
    assert read_stored(spark, str(tmp_path), "attendance").count() == 4


@pytest.mark.parametrize("output", ["user_messages", "stored"])
def test_a_rerun_batch_reads_the_school_of_its_first_try(spark, tmp_path, monkeypatch, output):
    school(spark).write(str(tmp_path / "school"))
    read = lambda: School.read(spark, str(tmp_path / "school"))
    deliver(spark, tmp_path / "feed", "attendance", FIRST)
    write = sinks.write_batch

    def lost(rows, folder, name, batch):
        if name == output:
            raise RuntimeError("lost")
        return write(rows, folder, name, batch)

    monkeypatch.setattr(sinks, "write_batch", lost)
    with pytest.raises(Exception):
        run(spark, _Lazily(read), tmp_path / "feed", tmp_path)
    before = rows_of(read_messages(spark, str(tmp_path)))
    changed = read()
    staff = [(row.staffId, "Renamed", row.firstName, row.userId) for row in changed.staff.collect()]
    table(spark, "staff", staff).write.mode("overwrite").parquet(str(tmp_path / "school/staff.parquet"))
    users = [(row.userId, row.userType) for row in changed.users.collect()] + [(901, "A")]
    table(spark, "users", users).write.mode("overwrite").parquet(str(tmp_path / "school/users.parquet"))
    monkeypatch.setattr(sinks, "write_batch", write)
    run(spark, _Lazily(read), tmp_path / "feed", tmp_path)
    assert rows_of(read_messages(spark, str(tmp_path))) == before
    assert 901 not in [row[1] for row in rows_of(read_user_messages(spark, str(tmp_path)))]
    # The next batch sees the change.
    late = [presence(1, 1, T(2022, 1, 1), 2, "late", True, "z1")]
    deliver(spark, tmp_path / "feed", "attendance", late)
    run(spark, _Lazily(read), tmp_path / "feed", tmp_path)
    texts = dict(rows_of(read_messages(spark, str(tmp_path)), "messageId", "text"))
    assert texts["attendance:z1"].startswith("Teacher-Renamed")
    assert 901 in [row[1] for row in rows_of(read_user_messages(spark, str(tmp_path)))]
    assert [p.name for p in (tmp_path / "pinned").iterdir()] == ["batch=1"]


class _Lazily:
    """Stands for a school that is read when it is asked for a table."""

    def __init__(self, read):
        self._read = read

    def __getattr__(self, name):
        return getattr(self._read(), name)


def test_changes_without_ids_have_distinct_messages(spark):
    made = school(spark)
    rows = [
        (*presence(student, 1, T(2020, 1, day), 2, note, True)[:-1], None)
        for student, day, note in ((1, 1, "n"), (1, 1, "n"), (2, 1, None), (2, 2, "n"), (1, 2, ":"), (1, 2, ""))
    ]
    alerts = attendance_alerts(made, table(spark, "attendance", rows))
    ids = [row[0] for row in rows_of(alerts.messages, "messageId")]
    admins = made.users.filter(F.col("userType") == "A").count()
    assert len(set(ids)) == len(ids) == 6
    assert len(set(rows_of(alerts.user_messages))) == 6 * admins
    assert [row[0] for row in rows_of(alerts.stored, "changeId")] == [None] * 6
    again = attendance_alerts(made, table(spark, "attendance", rows[::-1]).repartition(3))
    assert sorted(row[0] for row in rows_of(again.messages, "messageId")) == sorted(ids)
    # Columns that only differ by where one ends are told apart.
    pair = spark.createDataFrame([("ab", "c", None), ("a", "bc", None)], "x string, y string, changeId string")
    assert with_change_ids(pair).select("changeId").distinct().count() == 2


def test_changes_without_ids_in_two_batches_have_distinct_messages(spark, tmp_path):
    made = school(spark)
    rows = [(*presence(1, 1, T(2020, 1, 1), 2, "n", True)[:-1], None)] * 2
    for _ in range(2):
        deliver(spark, tmp_path / "feed", "attendance", rows)
        run(spark, made, tmp_path / "feed", tmp_path)
    ids = [row[0] for row in rows_of(read_messages(spark, str(tmp_path)), "messageId")]
    assert len(set(ids)) == len(ids) == 4
    admins = made.users.filter(F.col("userType") == "A").count()
    assert len(set(rows_of(read_user_messages(spark, str(tmp_path))))) == 4 * admins


DAY = T(2023, 5, 1)
VERSIONS = [
    [presence(1, 1, DAY, 2, "insert", False, "v1")],
    [presence(1, 1, DAY, 3, "flagged", True, "v2")],
    [presence(1, 1, DAY, 2, "unflagged", False, "v3"), presence(1, 1, T(2023, 5, 2), 3, "own", None, "v4")],
]


def stored_by_stream(spark, tmp_path, made):
    for rows in VERSIONS:
        deliver(spark, tmp_path / "feed", "attendance", rows)
        run(spark, made, tmp_path / "feed", tmp_path / "out")
    return str(tmp_path / "out")


def test_the_report_sees_the_current_row(spark, tmp_path):
    made = school(spark)
    made.write(str(tmp_path / "school"))
    base = made.attendance.count()
    out = stored_by_stream(spark, tmp_path, made)
    now = read_current(spark, str(tmp_path / "school"), {"attendance": out})
    rows = now.attendance.filter(F.col("attendanceDate") >= DAY)
    assert sorted(rows_of(rows, "note", "attendanceStatusId", "flagAdministrator")) == [
        ("own", 3, None), ("unflagged", 2, False),
    ]
    assert now.attendance.count() == base + 2
    assert len(read_messages(spark, out).collect()) == 1
    report = plans.report_student_attendance(now, 1, "2023-05-01", "2023-05-31", as_of=dt.date(2024, 1, 1))
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW v AS SELECT * FROM read_parquet('{out}/stored/*/*.parquet', hive_partitioning=true)")
    keys = ", ".join(f'"{key}"' for key in ROW_KEYS["attendance"])
    counted = sql.sql(
        f"""SELECT count(*) FILTER (WHERE "attendanceStatusId" = 2),
              count(*) FILTER (WHERE "attendanceStatusId" = 3)
            FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY batch DESC) AS n FROM v)
            WHERE n = 1 AND "studentId" = 1"""
    ).fetchall()
    assert [tuple(row[:2]) for row in report.collect()] == counted == [(1, 1)]


def test_compaction_changes_no_row_and_is_read_next(spark, tmp_path):
    made = school(spark)
    out = stored_by_stream(spark, tmp_path, made)
    before = sorted(map(str, rows_of(current(spark, made.attendance, "attendance", out))))
    assert compacted(spark, out) == -1
    assert compact(spark, made.attendance, "attendance", out) == 2
    assert compact(spark, made.attendance, "attendance", out) == 2
    # From here on the given table is not needed.
    none = made.attendance.limit(0)
    assert sorted(map(str, rows_of(current(spark, none, "attendance", out)))) == before
    last = presence(1, 1, DAY, 1, "last", False, "v9")
    deliver(spark, tmp_path / "feed", "attendance", [last])
    run(spark, made, tmp_path / "feed", tmp_path / "out")
    assert "last" in {row[0] for row in rows_of(current(spark, none, "attendance", out), "note")}
    assert compact(spark, none, "attendance", out) == 3
    (tmp_path / "out/current/upto=3/_SUCCESS").unlink()
    assert compacted(spark, out) == 2
    assert "last" in {row[0] for row in rows_of(current(spark, none, "attendance", out), "note")}
    assert compact(spark, none, "attendance", out) == 3
    forget(spark, out)
    assert [p.name for p in (tmp_path / "out/current").iterdir()] == ["upto=3"]


def test_versions_of_null_keys_and_of_one_batch(spark, tmp_path):
    made = school(spark)
    rows = [
        presence(None, 1, DAY, 2, "old", False, "a9"),
        presence(None, 1, DAY, 3, "new", False, "a10"),
        presence(2, None, None, 3, "b", False, "b"),
    ]
    alerts = attendance_alerts(made, table(spark, "attendance", rows))
    sinks.write_alerts(alerts, str(tmp_path), 0)
    empty = made.attendance.limit(0)
    notes = sorted(row[0] for row in rows_of(current(spark, empty, "attendance", str(tmp_path)), "note"))
    assert notes == ["b", "new"]


def test_ledger_filters_and_fresh_changes_do_not_sort_what_they_read(spark, tmp_path):
    taken = Ledger(spark, str(tmp_path / "ledger"))
    ids = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("changeId"))
    asked = _places(ids)
    direct = asked.groupBy("bucket", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
    made = _bitmaps(asked)
    as_rows = lambda frame: {(r["bucket"], r["segment"]): bytes(r["bits"]) for r in frame.collect()}
    assert as_rows(made) == as_rows(direct)
    # The places are hashed, not sorted, before their first shuffle.
    assert "partial_bit_or" in explained(made)
    changes = ids.withColumn("n", F.col("changeId")).unionByName(ids.limit(5).withColumn("n", F.lit("a")))
    changes = changes.unionAll(spark.sql("SELECT CAST(NULL AS STRING), x FROM VALUES ('u'), ('u'), ('v') AS t(x)"))
    fresh = taken.fresh(changes, 0)
    assert explained(fresh).count("Exchange (") == explained(changes).count("Exchange (") + 1
    rows = fresh.collect()
    assert len(rows) == 3003 and sorted(r["n"] for r in rows if r["changeId"] is None) == ["u", "u", "v"]
    assert sum(r["n"] == "a" for r in rows) == 5


def test_versions_of_single_keys_are_merged_where_they_lie(spark, derived, tmp_path, monkeypatch):
    key = (1, 1, T(2020, 1, 1))
    rows = [
        (*key, 1, "old", False, "a"),
        # Equal keys of the table without a version all stay, also of null keys.
        (2, 1, T(2020, 1, 1), 1, "copy", False, "b"),
        (2, 1, T(2020, 1, 1), 1, "copy", False, "b"),
        (None, 1, T(2020, 1, 1), 1, "null key", False, "c"),
        (None, 2, None, 1, "replaced", False, "d"),
    ]
    versions = [
        (*key, 2, "first", False, "9", 0),
        (*key, 2, "second", False, "10", 0),
        (*key, 2, "last", False, None, 1),
        (None, 2, None, 2, "new", None, "e", 0),
        (7, 1, T(2020, 1, 1), 2, "added", False, "f", 1),
    ]
    listed = table(spark, "attendance", rows)
    stored = spark.createDataFrame(versions, StructType([*TABLES["attendance"].fields, StructField("batch", LongType())]))
    names = ["added", "copy", "copy", "last", "new", "null key"]

    def notes():
        return sorted(row[0] for row in rows_of(merged(listed, stored, ROW_KEYS["attendance"]), "note"))

    assert notes() == names
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    assert notes() == names
    monkeypatch.setattr("tasktrail.sources.versions.shared_folder", lambda spark: None)
    assert notes() == names
    monkeypatch.undo()
    # Each row has its one version: nothing is shuffled but the keys beforehand.
    ids = [(n, 1, T(2020, 1, 1), 1, "old", False, str(n)) for n in range(50)]
    given = table(spark, "attendance", ids)
    newer = given.withColumns({"note": F.lit("new"), "batch": F.lit(0).cast("long")})
    with settings(spark, NO_BROADCAST):
        now = merged(given, newer, ROW_KEYS["attendance"])
        assert "hashpartitioning" not in final_plan(now)
        assert rows_of(now, "note") == [("new",)] * 50


def test_changes_with_ids_of_their_own_stay_where_they_lie(spark, tmp_path, monkeypatch):
    rows = [(n, 1, T(2020, 1, 1), 1, f"n{n}", False, None if n % 10 == 0 else str(n)) for n in range(40)]
    twice = [(99, 1, T(2020, 1, 1), 1, "later by its columns", False, "7"), rows[8]]
    taken = Ledger(spark, f"{tmp_path}/ledger")
    single, changes = table(spark, "attendance", rows), table(spark, "attendance", rows + twice)
    with settings(spark, NO_BROADCAST):
        fresh = taken.fresh(single, 0, taken.repeated(single, 0))
        assert "hashpartitioning" not in final_plan(fresh) and "ShufflePartitionId" not in final_plan(fresh)
    assert sorted(rows_of(fresh, "note")) == sorted((row[4],) for row in rows)
    repeated = taken.repeated(changes, 1)
    assert sorted(rows_of(repeated)) == [("7",), ("8",)]
    few = taken.fresh(changes, 1, repeated)
    assert few.columns == changes.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, taken.fresh(changes, 1).collect()))
    assert few.count() == 40 and few.filter("note LIKE 'later%'").count() == 0
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    assert taken.repeated(changes, 1) is None


def test_a_batch_is_written_aside_while_it_runs(spark, tmp_path):
    changes = table(spark, "attendance", [presence(1, 1, T(2020, 1, 1), 2, "n", True, "a")])
    path = sinks.write_batch(changes, str(tmp_path), "staged", 0)
    assert rows_of(spark.read.schema(changes.schema).parquet(path)) == rows_of(changes)
    sinks.delete(spark, path)
    assert not (tmp_path / "staged/batch=0").exists()
