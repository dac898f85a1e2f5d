"""Task attempts: first presentations, latest per key, date-limited sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tasktrail.functions.constants import FIRST_PRESENTATION
from tasktrail.functions.filters import DateLike, all_known, within, without_year
from tasktrail.operators.lookups import attach
from tasktrail.sources.school import School

ATTEMPT_KEY = ("staffId", "studentId", "taskId")
# Keys are counted by so many hashes; those with more rows than one task should hold are hot.
HASHES = 1 << 16
HOT_ROWS = 500_000
LOOKUPS = ("evaluations", "evaluation_types", "staff", "students")
_LOOKUP_KEYS = {
    "evaluations": "evaluationId",
    "evaluation_types": "evaluationTypeId",
    "staff": "staffId",
    "students": "studentId",
}


def first_presentations(
    attempts: DataFrame, school: School | None = None, validate: Sequence[str] = ()
) -> DataFrame:
    """Every attempt marked as first presentation, with its date renamed.

    Several first presentations of one key all stay. ``validate`` names the lookup
    tables in which the row's ids must exist.
    """
    first = attempts.filter(F.col("evaluationTypeId") == FIRST_PRESENTATION)
    for name in validate:
        key = _LOOKUP_KEYS[name]
        known = getattr(school, name).select(key)
        first = attach(first, known, key, "left_semi", size=school.size(name))
    return first.select(
        "studentId",
        "staffId",
        "taskId",
        F.col("evaluationDate").alias("firstPresentationDate"),
        "evaluationTypeId",
    )


def latest_dates(attempts: DataFrame, start: DateLike = None) -> DataFrame:
    """The latest date of each staff, student and task; aggregated before the shuffle.

    With ``start`` only of keys whose latest date is not earlier. Dropping earlier
    attempts beforehand does not change these: it can only lose keys that drop out.
    """
    known = attempts.filter(all_known(*ATTEMPT_KEY))
    if start is not None:
        known = within(known, "evaluationDate", start)
    return known.groupBy(*ATTEMPT_KEY).agg(F.max("evaluationDate").alias("evaluationDate"))


def latest_attempts(
    attempts: DataFrame, start: DateLike = None, all_read: bool = False
) -> DataFrame:
    """Attempts on the latest date of their staff, student and task; ties all stay.

    The maximum is matched back by a semi join on key and date. A window over the key
    would send a hot key to one task; here its rows are spread by date, and rows of
    one date can still be split because the semi join only streams them. Rows with a
    null key or date drop out. ``start`` as in ``latest_dates``.

    ``all_read`` says that the caller reads all columns. Then only the keys that may be hot
    (``_hot_keys``) are found so, which takes three shuffles. The others are shuffled once, by
    key: their maximum is made where they lie.
    """
    later = attempts if start is None else within(attempts, "evaluationDate", start)
    if not all_read:
        return _matched(later, latest_dates(attempts, start))
    later = later.filter(all_known(*ATTEMPT_KEY, "evaluationDate"))
    hot = F.broadcast(_hot_keys(later))
    named = later.withColumn("_hash", _key_hash())
    spread = named.join(hot, "_hash", "left_semi").drop("_hash")
    dealt = named.join(hot, "_hash", "left_anti").drop("_hash").repartition(*ATTEMPT_KEY)
    # Made of whole rows, so that both sides of the join read one shuffle of the same columns.
    others = [name for name in dealt.columns if name not in (*ATTEMPT_KEY, "evaluationDate")]
    last = F.max(F.struct("evaluationDate", *others))["evaluationDate"].alias("_last")
    dates = dealt.groupBy(*ATTEMPT_KEY).agg(last)
    # An inner join, as a semi join would be moved below the shuffle of its left side; and no
    # equality, as the date would become part of the key.
    latest = dealt.join(dates, list(ATTEMPT_KEY)).filter(F.col("evaluationDate") >= F.col("_last"))
    latest = latest.select(*later.columns)
    return latest.unionByName(_matched(spread, latest_dates(spread)))


def _matched(attempts: DataFrame, dates: DataFrame) -> DataFrame:
    return attempts.join(dates, [*ATTEMPT_KEY, "evaluationDate"], "left_semi")


def _key_hash() -> Column:
    return F.pmod(F.xxhash64(*ATTEMPT_KEY), F.lit(HASHES)).cast("int")


def _hot_keys(attempts: DataFrame) -> DataFrame:
    """Hashes of keys that more than ``HOT_ROWS`` attempts share; at most ``HASHES`` of them."""
    counts = attempts.groupBy(_key_hash().alias("_hash")).agg(F.count("*").alias("_rows"))
    return counts.filter(F.col("_rows") > HOT_ROWS).select("_hash")


def select_attempts(
    attempts: DataFrame,
    latest: bool | None = False,
    start: DateLike = None,
    end: DateLike = None,
    all_read: bool = False,
) -> DataFrame:
    """The attempts a report works on: all or the latest ones, limited by date.

    The latest attempt is found first and limited afterwards, so a key whose latest
    attempt is outside the range has no attempt at all. The start may be applied at once,
    the end may not: a later attempt has to be seen. ``all_read`` as in ``latest_attempts``.
    """
    chosen = latest_attempts(attempts, start, all_read) if latest else attempts
    return without_year(within(chosen, "evaluationDate", start, end))


def attempted_tasks(
    attempts: DataFrame, latest: bool | None = False, start: DateLike = None, end: DateLike = None
) -> DataFrame:
    """The distinct student and task pairs of ``select_attempts``, without its join.

    Without an end every key has a latest attempt if it has one at all.
    """
    if latest and end is None:
        attempts = attempts.filter(all_known(*ATTEMPT_KEY))
    dates = latest_dates(attempts, start) if latest and end is not None else attempts
    limited = within(dates, "evaluationDate", start, end)
    return limited.select("studentId", "taskId").distinct()
