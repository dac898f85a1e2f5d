"""Shards of near equal bytes by a minimax contiguous partition.

Rows of equal text form an atomic group. Groups are ordered by the hash of their text,
and the ordered groups are cut into shards so that the fullest shard is as small as any
such cuts allow: a binary search over capacities, each checked by filling shards one
after the other.

The driver sees totals of ranges of hashes, never all groups. Ranges that hold several
groups are split further only where a cut of the final answer may fall, so the capacity
and the cuts are exact. Each round sees at most ``FIRST_BITS`` bits worth of ranges plus
256 for each that a cut may reach.

A group larger than an even share would leave the shards next to it empty. Such a group,
of which there are fewer than shards, gets a shard of its own, and the others share the
rest by the same search.

All of it is DataFrame functions. Null texts count as empty and form one group with
empty texts. Repeated rows are placed once each. No row gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tasktrail.llm.common import written

ROW_BYTES = 16
SHARDS = 40
FIRST_BITS = 16
STEP_BITS = 8
HASH_BITS = 64
# Rows of one range of hashes that are numbered by one task.
ROWS_PER_LANE = 50_000


@dataclass(frozen=True)
class Ranges:
    """Ordered ranges of hashes: first hash, bytes, whether one group fills it, depth in bits."""

    first: np.ndarray
    size: np.ndarray
    atomic: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, found: Sequence, bits: int) -> Ranges:
        return cls(
            np.array([row["first"] for row in found], np.int64),
            np.array([row["size"] for row in found], np.int64),
            np.array([row["first"] == row["last"] for row in found], bool),
            np.full(len(found), bits),
        ).sorted()

    def sorted(self) -> Ranges:
        order = np.argsort(self.first)
        return Ranges(self.first[order], self.size[order], self.atomic[order], self.bits[order])

    def replace(self, dropped: np.ndarray, others: Ranges) -> Ranges:
        kept = ~dropped
        return Ranges(
            np.concatenate([self.first[kept], others.first]),
            np.concatenate([self.size[kept], others.size]),
            np.concatenate([self.atomic[kept], others.atomic]),
            np.concatenate([self.bits[kept], others.bits]),
        ).sorted()

    def ends(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])


def _fill(ranges: Ranges, ends: np.ndarray, capacity: int, shards: int, fluid: bool) -> list[int]:
    """Where the shards end, in bytes, if each is filled in turn, as far as the shards suffice.

    ``fluid``: ranges of several groups may be cut anywhere, which no real cut can beat;
    otherwise only between ranges, which real cuts can always match.
    """
    total, at, found = int(ends[-1]), 0, []
    while at < total and len(found) < shards:
        reach = min(at + capacity, total)
        index = int(np.searchsorted(ends, reach, "right")) - 1
        if not (fluid and index < len(ranges.atomic) and not ranges.atomic[index]):
            reach = int(ends[index])
        if reach <= at:
            break
        found.append(reach)
        at = reach
    return found


def _smallest(ranges: Ranges, shards: int, fluid: bool) -> int:
    """The smallest capacity with which the shards suffice."""
    ends = ranges.ends()
    total = int(ends[-1])
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if _fill(ranges, ends, middle, shards, fluid)[-1:] == [total]:
            high = middle
        else:
            low = middle + 1
    return low


def _top(key: str | Column, bits: int) -> Column:
    return F.shiftright(key, HASH_BITS - bits)


def _totals(rows: DataFrame, bits: int) -> DataFrame:
    """Totals of the ranges that share their first ``bits`` bits."""
    return rows.groupBy(_top("_key", bits).alias("_range")).agg(
        F.min("_key").alias("first"),
        F.max("_key").alias("last"),
        F.sum("size").alias("size"),
        F.count("*").alias("rows"),
    )


def _split(rows: DataFrame, ranges: Ranges) -> Ranges:
    """The same hashes in ranges that are ``STEP_BITS`` deeper."""
    spark = rows.sparkSession
    parts = []
    for bits in np.unique(ranges.bits).tolist():
        prefixes = ranges.first[ranges.bits == bits] >> np.int64(HASH_BITS - bits)
        wanted = spark.createDataFrame([(int(one),) for one in prefixes], "_open long")
        inside = rows.join(F.broadcast(wanted), _top("_key", bits) == F.col("_open"), "left_semi")
        deeper = min(HASH_BITS, bits + STEP_BITS)
        parts.append(Ranges.of(_totals(inside, deeper).collect(), deeper))
    return reduce(lambda one, other: one.replace(np.zeros(len(one.size), bool), other), parts)


def minimax_cuts(rows: DataFrame, ranges: Ranges, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the first hash of every shard but the first.

    ``rows`` has ``_key`` and ``size``; ``ranges`` are its totals by ``FIRST_BITS`` bits.
    """
    while True:
        ends = ranges.ends()
        low, high = _smallest(ranges, shards, True), _smallest(ranges, shards, False)
        if low == high:
            cuts = _fill(ranges, ends, high, shards, False)[:-1]
            return high, [int(ranges.first[np.searchsorted(ends, cut)]) for cut in cuts]
        # For every capacity between the two, the end of a shard lies between these.
        early = _fill(ranges, ends, low, shards, False) or [0]
        late = _fill(ranges, ends, high, shards, True)
        reached = np.zeros(len(ranges.size), bool)
        for index, end in enumerate(late):
            start = min(end, early[min(index, len(early) - 1)])
            first = max(0, int(np.searchsorted(ends, start, "right")) - 1)
            reached[first : int(np.searchsorted(ends, end, "left")) + 1] = True
        reached &= ~ranges.atomic
        opened = Ranges(
            ranges.first[reached], ranges.size[reached], ranges.atomic[reached], ranges.bits[reached]
        )
        ranges = ranges.replace(reached, _split(rows, opened))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_key"),
        ),
        "shard-rows",
    )
    giants: list[int] = []
    rest, found = rows, _totals(rows, FIRST_BITS).collect()
    while more := _giants(rest, found, shards - len(giants)):
        giants += more
        rest = rows.filter(~F.col("_key").isin(giants))
        found = _totals(rest, FIRST_BITS).collect()
    ranges = Ranges.of(found, FIRST_BITS)
    cuts = minimax_cuts(rest, ranges, shards - len(giants))[1] if found else []
    shard = F.lit(len(giants))
    for cut in cuts:
        shard = shard + (F.col("_key") >= cut).cast("int")
    for number, key in enumerate(giants):
        shard = F.when(F.col("_key") == key, F.lit(number)).otherwise(shard)
    placed = _numbered(rows.withColumn("shard", shard.cast("int")))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def _giants(rows: DataFrame, found: Sequence, shards: int) -> list[int]:
    """Groups larger than an even share of what the larger ones leave."""
    total = sum(row["size"] for row in found)
    # Only a range larger than an even share can hold such a group; there are few.
    wide = [row["_range"] for row in found if row["size"] * shards > total]
    if not wide:
        return []
    groups = (
        rows.filter(_top("_key", FIRST_BITS).isin(wide)).groupBy("_key").agg(F.sum("size").alias("size"))
    )
    large = groups.orderBy(F.desc("size"), "_key").limit(shards).collect()
    giants: list[int] = []
    for row in large:
        if row["size"] * (shards - len(giants)) <= total or len(giants) == shards - 1:
            break
        giants.append(row["_key"])
        total -= row["size"]
    return giants


def _numbered(placed: DataFrame) -> DataFrame:
    """Gapless slots: ranges of hashes and lanes are counted, then rows within them.

    A range with many rows, such as that of a text with very many copies, is dealt to
    lanes by id, so no task numbers more than about ``ROWS_PER_LANE`` rows.
    """
    keyed = placed.withColumn("_range", _top("_key", FIRST_BITS).cast("int"))
    lanes = keyed.groupBy("_range").agg(
        (1 + F.floor(F.count("*") / ROWS_PER_LANE)).cast("int").alias("_lanes")
    )
    # At most two to the power FIRST_BITS rows of two integers.
    keyed = keyed.join(F.broadcast(lanes), "_range").withColumn(
        "_lane", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("_lanes")).cast("int")
    )
    cell = ["shard", "_range", "_lane"]
    earlier = (
        Window.partitionBy("shard")
        .orderBy("_range", "_lane")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = (
        keyed.groupBy(*cell)
        .agg(F.count("*").alias("_rows"))
        .select(*cell, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*cell).orderBy("_key", "doc_id")
    return (
        keyed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(cells, cell)
        .withColumn("slot", (F.col("_place") + F.col("_before")).cast("long"))
    )
