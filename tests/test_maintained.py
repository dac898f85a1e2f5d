"""Maintained attempts equal what is found anew in the fact after every batch."""

import datetime as dt
import random

import pytest

from tasktrail import plans
from tasktrail.operators import maintained
from tasktrail.operators.attempts import latest_attempts
from tasktrail.operators.maintained import COPIES, MOMENT, MaintainedAttempts
from tasktrail.sources.versions import ROW_KEYS
from tests.schools import attempt, rows_of, school, table
from tests.test_plans import explained, scans

T = dt.datetime


def attempts(spark, rows):
    return table(spark, "task_evaluations", rows)


def seen(frame):
    return sorted(map(str, rows_of(frame, *MOMENT)))


def agrees(spark, kept, rows, upto=None):
    fact = attempts(spark, rows)
    return seen(kept.attempts(upto)) == seen(fact) and seen(kept.latest(upto)) == seen(latest_attempts(fact))


def made_up(rng):
    return attempt(
        student=rng.choice([1, 1, 2, 3, None]),
        staff=rng.choice([1, 2]),
        task=rng.choice([11, 12, None]),
        mark=rng.choice(["WO", "MA", None]),
        kind=rng.choice(["FP", "EV"]),
        when=rng.choice([T(2020, 1, 1), T(2020, 1, 2, 3, 4, 5, 6), T(2021, 1, 1), None]),
    )


def test_batches_with_retractions(spark, tmp_path):
    rng = random.Random(0)
    kept = MaintainedAttempts(spark, str(tmp_path), buckets=3)
    rows: list[tuple] = []
    history = []
    for batch in range(4):
        added = [made_up(rng) for _ in range(25)]
        removed = rng.sample(rows, len(rows) // 2)
        for row in removed:
            rows.remove(row)
        rows += added
        kept.add(batch, attempts(spark, added), attempts(spark, removed))
        history.append(list(rows))
        assert agrees(spark, kept, rows)
    for batch, then in enumerate(history):
        assert agrees(spark, kept, then, upto=batch)
    kept.forget()
    assert agrees(spark, kept, rows)


def test_the_latest_date_falls_back_and_a_key_goes(spark, tmp_path):
    kept = MaintainedAttempts(spark, str(tmp_path))
    early, late = attempt(when=T(2020, 1, 1)), attempt(when=T(2021, 1, 1))
    kept.add(0, attempts(spark, [early, late, late]))
    assert rows_of(kept.latest(), "evaluationDate") == [(T(2021, 1, 1),)] * 2
    kept.add(1, removed=attempts(spark, [late]))
    assert rows_of(kept.latest(), "evaluationDate") == [(T(2021, 1, 1),)]
    kept.add(2, removed=attempts(spark, [late]))
    assert rows_of(kept.latest(), "evaluationDate") == [(T(2020, 1, 1),)]
    kept.add(3, removed=attempts(spark, [early]))
    assert rows_of(kept.latest()) == rows_of(kept.attempts()) == []
    # What is taken back too early is owed.
    kept.add(4, removed=attempts(spark, [late]))
    assert rows_of(kept.attempts()) == []
    kept.add(5, attempts(spark, [late, early]))
    assert rows_of(kept.latest(), "evaluationDate") == [(T(2020, 1, 1),)]


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    kept = MaintainedAttempts(spark, str(tmp_path), buckets=64)
    kept.add(0, attempts(spark, [attempt(student=n) for n in range(300)]))
    kept.add(1, attempts(spark, [attempt(student=7, when=T(2022, 1, 1))]))
    written = lambda batch: len(list((tmp_path / f"batch={batch}/moments").glob("bucket=*")))
    assert (written(0), written(1)) == (64, 1)
    kept.forget()
    assert (written(0), written(1)) == (63, 1)
    assert kept.attempts().count() == 301


def test_a_batch_that_broke_off_does_not_count_and_runs_again(spark, tmp_path):
    kept = MaintainedAttempts(spark, str(tmp_path))
    first, second = [attempt()], [attempt(when=T(2021, 1, 1)), attempt(student=2)]
    kept.add(0, attempts(spark, first))
    kept.add(1, attempts(spark, second))
    (tmp_path / "batch=1/touched/_SUCCESS").unlink()
    assert agrees(spark, kept, first)
    for _ in range(2):
        kept.add(1, attempts(spark, second))
        assert agrees(spark, kept, first + second)


def test_stored_versions_replace_rows(spark, tmp_path):
    kept = MaintainedAttempts(spark, str(tmp_path))
    twice = [attempt(mark="WO"), attempt(mark="NM"), attempt(task=None, when=None)]
    kept.add(0, attempts(spark, twice))
    kept.store(
        1,
        attempts(
            spark,
            [
                attempt(mark="MA", change="v10"),
                attempt(mark="NA", change="v9"),
                attempt(task=None, when=None, mark="MA"),
                attempt(when=T(2022, 1, 1)),
            ],
        ),
    )
    now = [attempt(mark="MA"), attempt(task=None, when=None, mark="MA"), attempt(when=T(2022, 1, 1))]
    assert agrees(spark, kept, now)
    assert len({tuple(row) for row in rows_of(kept.attempts(), *ROW_KEYS["task_evaluations"])}) == 3


def test_no_rows_other_columns_and_many_copies(spark, tmp_path):
    kept = MaintainedAttempts(spark, str(tmp_path))
    assert rows_of(kept.attempts()) == rows_of(kept.latest()) == []
    kept.add(0, attempts(spark, []))
    assert rows_of(kept.latest()) == []
    copies = attempts(spark, [attempt()]).crossJoin(spark.range(2 * COPIES + 1)).withColumnRenamed("id", "rows")
    kept.add(1, copies)
    assert kept.latest().count() == kept.attempts().count() == 2 * COPIES + 1
    assert kept.moments().count() == 1
    with pytest.raises(ValueError, match="neither"):
        kept.add(2)
    with pytest.raises(ValueError, match="64 buckets"):
        MaintainedAttempts(spark, str(tmp_path), buckets=8).latest()


@pytest.mark.parametrize(
    "latest, dates", [(True, (None, None)), (True, ("2020-01-01", "2020-12-31")), (False, (None, "2020-06-30"))]
)
def test_reports_do_not_read_the_fact(spark, tmp_path, latest, dates):
    rows = [
        attempt(kind="FP", when=T(2020, 1, 1)),
        attempt(when=T(2020, 2, 1)),
        attempt(when=T(2020, 2, 1)),
        attempt(mark="MA", when=T(2021, 2, 1)),
        attempt(student=2, task=12, when=T(2020, 3, 1)),
    ]
    made = school(spark, task_evaluations=rows)
    kept = MaintainedAttempts(spark, str(tmp_path / "kept"), buckets=2)
    kept.add(0, made.task_evaluations)
    made.task_evaluations.write.parquet(str(tmp_path / "fact"))
    made = made.replace(task_evaluations=spark.read.parquet(str(tmp_path / "fact")))
    day = dt.date(2024, 1, 1)
    for report in (
        lambda **more: plans.progress_report_individual(made, None, 0, latest, *dates, **more),
        lambda **more: plans.progress_report_benchmark(made, 1, 1, latest, *dates, as_of=day, **more),
    ):
        assert sorted(map(str, report(maintained=kept).collect())) == sorted(map(str, report().collect()))
        plan = explained(report(maintained=kept))
        assert not scans(plan, "fact") and scans(plan, "kept")


def test_a_rewrite_shuffles_its_rows_once_and_parts_large_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintained, "ROWS_PER_TASK", 20)
    kept = MaintainedAttempts(spark, str(tmp_path), buckets=2)
    rng = random.Random(1)
    rows = [made_up(rng) for _ in range(200)]
    kept.add(0, attempts(spark, rows))
    kept.add(1, removed=attempts(spark, rows[:50]))
    assert agrees(spark, kept, rows[50:]) and agrees(spark, kept, rows, upto=0)
    files = [list(one.glob("*.parquet")) for one in (tmp_path / "batch=1/moments").glob("bucket=*")]
    assert max(map(len, files)) > 1
    assert {one.name for one in (tmp_path / "batch=1").iterdir() if one.is_dir()} == {"moments", "touched"}
    marked = kept._marked(kept.moments().unionAll(kept.moments(upto=0)), 4)
    assert explained(marked).count("Exchange (") == 1
