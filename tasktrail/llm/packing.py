"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut.
What the packing needs to know about all pieces is how many there are of each length: at
most ``capacity`` numbers, however many documents there are. On these counts bins are
filled one kind at a time: the longest length left takes its place, a subset-sum over the
lengths left, kept in the bits of an integer, finds the fullest combination with it, and
that combination is taken as often as the counts allow. Each kind of bin uses up the
stock of at least one length, so the plan stays a small table too. Pieces are then
numbered within their length and look up their place in the plan.

Null texts count as empty, and an empty document still has its end token. Repeated rows
are packed once each. Pieces of equal length are interchangeable; ties follow ``doc_id``,
``piece`` and the ids' checksum. No row gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tasktrail.llm.chunk_tokens import ChunkEncoder
from tasktrail.llm.common import documents_of, released, slices, written

CAPACITY = 2048
END = 0
# Pieces of one length that are numbered by one task.
PIECES_PER_LANE = 100_000
BATCH_ROWS = 1024

_ENCODERS: dict[str, ChunkEncoder] = {}


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` (binary, 32-bit little-endian)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), part.tobytes()))
                if len(rows) >= BATCH_ROWS:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)

    return documents_of(docs).mapInArrow(
        released(cut), "doc_id long, piece int, start long, length long, ids binary"
    )


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, piece, start, length, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_id, pa.int64()),
            pa.array(piece, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(ids, pa.binary()),
        ],
        ["doc_id", "piece", "start", "length", "ids"],
    )


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that their sum comes closest to ``room`` from below.

    Bounded subset-sum: bit s of ``reached`` says that s can be filled. Multiples of a
    length are taken in powers of two. Walking back from the shortest length skips what
    is not needed, so short lengths are kept for later bins.
    """
    reached, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            left -= take
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & mask
            take *= 2
        if reached >> room:
            break
    target = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not (before >> target) & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= length * take
    return chosen


def bin_kinds(counts: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The plan: how many bins to make of each kind, and what a bin of that kind holds."""
    left = {length: number for length, number in counts.items() if number > 0}
    kinds = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        held = fullest({n: k for n, k in rest.items() if k and n <= capacity - seed}, capacity - seed)
        held[seed] = held.get(seed, 0) + 1
        times = min(left[length] // number for length, number in held.items())
        kinds.append((times, held))
        for length, number in held.items():
            left[length] -= times * number
            if not left[length]:
                del left[length]
    return kinds


def places(kinds: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per kind and length: length, first rank, end rank, pieces a bin, first bin, offset."""
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for times, held in kinds:
        offset = 0
        for length in sorted(held, reverse=True):
            number, low = held[length], used.get(length, 0)
            used[length] = low + times * number
            rows.append((length, low, used[length], number, first_bin, offset))
            offset += number * length
        first_bin += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` needs doc_id, piece and length and is read several times, so it should be a
    written table without the ids. Ranks within a length are counted per lane first, so
    that a very common length is numbered by many tasks.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    plan = spark.createDataFrame(
        places(bin_kinds(counts, capacity)),
        "_length long, _low long, _end long, _number long, _bin long, _offset long",
    )
    lanes = 1 + max(counts.values(), default=0) // PIECES_PER_LANE
    lane = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes))
    dealt = pieces.withColumn("_lane", lane)
    cells = dealt.groupBy("length", "_lane").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("length").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "length", "_lane", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    ties = [name for name in pieces.columns if name not in ("length", "doc_id", "piece")]
    inside = Window.partitionBy("length", "_lane").orderBy("doc_id", "piece", *ties)
    ranked = dealt.withColumn("_place", F.row_number().over(inside) - 1).join(
        cells, ["length", "_lane"]
    )
    rank = F.col("_place") + F.col("_before")
    taken = rank - F.col("_low")
    found = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("_length")) & (rank >= F.col("_low")) & (rank < F.col("_end")),
    )
    return found.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(taken / F.col("_number"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(taken, F.col("_number")) * F.col("length"))
        .cast("long")
        .alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the checksum of their ids and their place."""
    pieces = token_pieces(docs, tokenizer_path, capacity)
    return pack(
        written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), capacity
    )
