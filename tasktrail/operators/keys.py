"""Duplicate keys as data, and as an error on request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tasktrail.functions.filters import all_known

# Keys that one report call expects to be unique.
ATTEMPT_MOMENT = ("taskId", "studentId", "evaluationDate")
FIRST_MOMENT = ("taskId", "studentId", "firstPresentationDate")
PATH_STEP = ("studentId", "suggestedTaskId")


class DuplicateKeyError(ValueError):
    """A table that must be unique on some columns is not."""


def key_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows.

    A key with a null part never violates uniqueness.
    """
    complete = rows.filter(all_known(*keys))
    return complete.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def require_unique(rows: DataFrame, keys: Sequence[str], name: str) -> None:
    """Raise ``DuplicateKeyError`` if any key occurs more than once. Runs a job."""
    example = key_violations(rows, keys).first()
    if example is not None:
        raise DuplicateKeyError(f"{name} is not unique on {', '.join(keys)}: {example.asDict()}")
