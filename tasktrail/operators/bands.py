"""Range lookups on whole numbers: letter grades and age groups.

A band is taken apart into aligned blocks, each a power of two long: at most two of any
length, whatever its width. A number lies in one block of each length, so the lookup is
an equi join on length and block. Nothing depends on how wide bands are or how large
numbers get, bands may overlap, and each number meets each of its bands once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tasktrail.functions.expressions import age_in_years
from tasktrail.operators.lookups import attach
from tasktrail.sources.school import School

# Lengths two to the power 0 to 32 cover every range of 32-bit numbers.
LENGTHS = 33


def band_blocks(bands: DataFrame, low: Column, high: Column) -> DataFrame:
    """``bands`` once per aligned block between low and high, both ends inclusive.

    Block b of length 2**k holds the numbers b * 2**k to (b + 1) * 2**k - 1. Of the blocks
    of a length that lie inside a band only the outermost can have a parent that does not.
    """
    bounded = bands.filter(low.isNotNull() & high.isNotNull())
    wide = bounded.select(
        "*",
        low.cast("long").alias("_low"),
        (high.cast("long") + 1).alias("_end"),
        F.explode(F.sequence(F.lit(0), F.lit(LENGTHS - 1))).alias("_length"),
    )
    first = F.expr("shiftright(_low + shiftleft(1L, _length) - 1L, _length)")
    last = F.expr("shiftright(_end, _length) - 1L")
    inside = wide.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    lone_first = F.expr("_first % 2 <> 0 OR _first + 1 > _last")
    lone_last = F.expr("_last <> _first AND (_last % 2 = 0 OR _last - 1 < _first)")
    blocks = F.array(F.when(lone_first, F.col("_first")), F.when(lone_last, F.col("_last")))
    return inside.select(*bands.columns, "_length", F.explode(blocks).alias("_block")).filter(
        F.col("_block").isNotNull()
    )


def in_bands(
    rows: DataFrame, number: Column, bands: DataFrame, low: Column, high: Column, school: School, name: str
) -> DataFrame:
    """``rows`` with each band that holds their whole ``number``; others drop out.

    ``name`` is that of the measured blocks. Only lengths that some block has are tried.
    """
    blocks = band_blocks(bands, low, high)
    size = school.size_of(name, blocks)
    lengths = school.known(name, lambda: sorted(r[0] for r in blocks.select("_length").distinct().collect()))
    if not lengths:
        return rows.join(bands.limit(0), F.lit(False))
    tried = rows.withColumn("_number", number.cast("long")).withColumn(
        "_length", F.explode(F.array(*map(F.lit, lengths)))
    )
    tried = tried.withColumn("_block", F.expr("shiftright(_number, _length)"))
    found = attach(tried, blocks, ["_length", "_block"], size=size, spread=True)
    return found.drop("_number", "_length", "_block")


def grade_bands(averages: DataFrame, school: School, average: str = "task_average") -> DataFrame:
    """Attach the letter band of a rounded average.

    An average in a gap between bands drops out; overlapping bands repeat the row.
    """
    return in_bands(
        averages,
        F.col(average),
        school.report_card_grades,
        F.col("rangeBottom"),
        F.col("rangeTop"),
        school,
        "grade blocks",
    )


def age_groups_of(ages: DataFrame, school: School) -> DataFrame:
    """Attach the groups of an ``age``, lower end inclusive, upper end exclusive."""
    groups = school.age_groups
    found = in_bands(
        ages,
        F.col("age"),
        groups,
        F.col("ageLowerRange"),
        F.col("ageUpperRange") - 1,
        school,
        "age blocks",
    )
    return found.drop("ageLowerRange", "ageUpperRange")


def age_bands(students: DataFrame, school: School, as_of: dt.date | None = None) -> DataFrame:
    """Attach the age groups of each student; overlapping groups repeat the student."""
    return age_groups_of(students.withColumn("age", age_in_years("dateOfBirth", as_of)), school)
