"""Repair of conversations by the cheapest edits, found by integer weights.

The rows of a conversation, in order of turn (null turns first; rows of one turn by role and
text), are kept (K), given the role that fits (R), deleted (D), or rows with an empty text
are inserted (I) so that the initials of the roles match ``(s?(ua)+)?``. Keep costs 0, a new
role, an insertion and a truncated row that stays 3 each, a deletion 4. Blank and duplicate
rows must go. Of the cheapest edits those with the least letters in ASCII order win.

A path through the rows is one integer: its high digits are the cost, below them each letter
has a place of fixed width (base 5, D 1, I 2, K 3, R 4) from the left, and places behind the
last letter are zero. The least integer is then the cheapest path with the least letters, so
a plain minimum over the edges of a directed acyclic graph decides everything. From one state
each edge writes another letter, so no path's letters are the beginning of another's.

Rows are dealt by ranges of (conversation, turn, role, digest of the text), so a conversation of
any length spreads over tasks. Runs of at most ``SEGMENT_ROWS`` rows of one conversation are
segments; a segment is worked off from each of the four states it may start in. What a
conversation gathers in one task afterwards is some hundred bytes per segment: costs between
states and the order of its letters. Copies of a row are one row with a count until then,
and the first of equal rows of a conversation is found by an aggregate that is joined back.

Nulls: a null role or text counts as one space (so a null text is blank, a null role never
fits); null conversation ids are one conversation; null turns come first. Empty tables
give empty results, further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tasktrail.llm.common import scratch_path

SEGMENT_ROWS = 512
SEGMENT_BYTES = 4 << 20

# Fixed by the contract: white space, sentence ends, costs.
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
REROLE, INSERT, TRUNCATED_STAYS, DELETE = 3, 3, 3, 4
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = "DIKR"
DIGIT = {letter: place + 1 for place, letter in enumerate(LETTERS)}
BASE = len(LETTERS) + 1

# States: nothing yet, after s, after u, after a. The one role that may follow, where an
# inserted or changed row leads, and where a kept row leads by its initial.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FITTING = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, **{(q, FITTING[q][0]): NEXT[q] for q in FITTING}}
# What ends a conversation from each state.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults; crc32 of ``conv_id:turn`` modulo 20 decides.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    name = F.concat_ws(
        ":",
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(name) % 20).alias("case"),
    ).filter(F.col("case") != 0)
    text = (
        F.when(F.col("case") == 1, "")
        .when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("case") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, whether they are the ``first`` of their role and text in
    the conversation, and the ``fault`` that their text alone has."""
    space = F.lit(" ")
    plain = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    distinct = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    named = distinct.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # False sorts before true: null turns come first.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = (
        named.groupBy("conv_id", "role", "digest")
        .agg(F.min(turn).alias("first_turn"))
        .withColumnsRenamed({"conv_id": "of", "role": "by", "digest": "says"})
    )
    joined = named.join(
        firsts,
        F.col("conv_id").eqNullSafe(F.col("of"))
        & (F.col("role") == F.col("by"))
        & (F.col("digest") == F.col("says")),
    )
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "digest",
        "copies",
        F.col("turn").eqNullSafe(F.col("first_turn.at")).alias("first"),
        F.when(core == "", BLANK)
        .when(~F.substring(core, -1, 1).isin(*ENDS), TRUNCATED)
        .otherwise(FINE)
        .alias("fault"),
    )


def relaxed(best: dict[int, tuple[int, int]], unit: int, power: list[int]) -> None:
    """Insertions in front of a row: at most two lead anywhere new. ``best``: weight, letters."""
    for _ in range(2):
        for state, (weight, size) in list(best.items()):
            offer(best, NEXT[state], weight, size, INSERT, "I", unit, power)


def offer(best, state, weight, size, cost, letter, unit, power) -> None:
    """Put a path longer by one letter down, if it is the least that leads to its state."""
    weight += cost * unit + DIGIT[letter] * power[-1 - size]
    known = best.get(state)
    if known is None or weight < known[0]:
        best[state] = weight, size + 1


def cheapest(rows: list[tuple[int, str]], start: int) -> dict[int, tuple[int, str]]:
    """By end state: cost and letters of the cheapest edits of rows (fault, role's initial)."""
    width = 3 * len(rows)
    power = [BASE**place for place in range(width)]
    unit = BASE**width
    best = {start: (0, 0)}
    for fault, initial in rows:
        relaxed(best, unit, power)
        after: dict[int, tuple[int, int]] = {}
        for state, (weight, size) in best.items():
            offer(after, state, weight, size, DELETE, "D", unit, power)
            if fault in (BLANK, DUPLICATE):
                continue
            stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
            kept = KEPT.get((state, initial))
            if kept is not None:
                offer(after, kept, weight, size, stays, "K", unit, power)
            offer(after, NEXT[state], weight, size, stays + REROLE, "R", unit, power)
        best = after
    return {
        state: (weight // unit, letters_of(weight % unit, width))
        for state, (weight, _) in best.items()
    }


def letters_of(digits: int, width: int) -> str:
    found = []
    for _ in range(width):
        digits, digit = divmod(digits, BASE)
        if digit:
            found.append(LETTERS[digit - 1])
    return "".join(reversed(found))


def edited(rows: list[dict], letters: str, state: int) -> list[tuple[str, str]]:
    """Role and text of what the edits leave."""
    left, at = [], 0
    for letter in letters:
        if letter == "I":
            left.append((FITTING[state], ""))
            state = NEXT[state]
            continue
        row, at = rows[at], at + 1
        if letter == "K":
            left.append((row["role"], row["text"]))
            state = KEPT[state, row["role"][:1]]
        elif letter == "R":
            left.append((FITTING[state], row["text"]))
            state = NEXT[state]
    return left


_ROW = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("fault", T.IntegerType()),
    ]
)


def _segment_schema(rows: DataFrame) -> T.StructType:
    own = [rows.schema["conv_id"]]
    own += [T.StructField(n, T.LongType()) for n in ("task", "number", "blank", "duplicate")]
    own += [T.StructField(n, T.LongType()) for n in ("truncated", "illegal", "turns")]
    own += [T.StructField(n, rows.schema["turn"].dataType) for n in ("first_turn", "last_turn")]
    own += [T.StructField(n, T.StringType()) for n in ("first_initial", "last_initial")]
    # Sixteen places, start state times four plus end state; -1: no way.
    own += [T.StructField("costs", T.ArrayType(T.LongType()))]
    own += [T.StructField("letters", T.ArrayType(T.StringType()))]
    # Order of the letters among the end states of one start state.
    own += [T.StructField("orders", T.ArrayType(T.IntegerType()))]
    own += [T.StructField("rows", T.ArrayType(_ROW))]
    return T.StructType(own)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _segment(conv_id, task: int, number: int, rows: list[tuple]) -> dict:
    """One row of the table of segments; ``rows``: turn, role, text, fault."""
    symbols = [(fault, role[:1]) for _, role, _, fault in rows]
    costs, letters, orders = [-1] * 16, [None] * 16, [-1] * 16
    for start in STATES:
        ends = cheapest(symbols, start)
        ranked = sorted(ends, key=lambda end: ends[end][1])
        for order, end in enumerate(ranked):
            costs[start * 4 + end], letters[start * 4 + end] = ends[end]
            orders[start * 4 + end] = order
    initials = [initial for _, initial in symbols]
    turns = {turn for turn, *_ in rows if turn is not None}
    faults = [fault for fault, _ in symbols]
    return {
        "conv_id": conv_id,
        "task": task,
        "number": number,
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(not legal(*pair) for pair in zip(initials, initials[1:])),
        "turns": len(turns),
        "first_turn": min(turns, default=None),
        "last_turn": max(turns, default=None),
        "first_initial": initials[0],
        "last_initial": initials[-1],
        "costs": costs,
        "letters": letters,
        "orders": orders,
        "rows": [{"role": role, "text": text, "fault": fault} for _, role, text, fault in rows],
    }


def _expanded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Every row with its fault: of copies all but the first are duplicates, if not blank."""
    for batch in batches:
        for conv_id, turn, role, text, copies, first, fault in zip(
            *(column.to_pylist() for column in batch.columns)
        ):
            for copy in range(copies):
                own = fault
                if fault != BLANK and (copy or not first):
                    own = DUPLICATE
                yield conv_id, turn, role, text, own


def _segments(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        made: list[dict] = []
        rows: list[tuple] = []
        conv_id, held, waiting = None, 0, 0
        for own_id, *row in _expanded(batches):
            if rows and (own_id != conv_id or len(rows) == SEGMENT_ROWS or held > SEGMENT_BYTES):
                made.append(_segment(conv_id, task, number, rows))
                number, waiting = number + 1, waiting + held + len(rows) * 50
                rows, held = [], 0
                if waiting > SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made, waiting = [], 0
            conv_id = own_id
            rows.append(tuple(row))
            held += len(row[2])
        if rows:
            made.append(_segment(conv_id, task, number, rows))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


class _Path:
    """The states between the segments of one conversation, least weight first."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.segments: list[tuple[int, int]] = []
        self.back: list[dict[int, int]] = []
        # By state: cost and place of its letters in ASCII order.
        self.best = {START: (0, 0)}
        self.totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = self.last_initial = None

    def add(self, segment: dict) -> None:
        self.segments.append((segment["task"], segment["number"]))
        found: dict[int, tuple[int, int]] = {}
        # Cost above, then the order of the letters so far, then that of the segment's.
        for state, (cost, order) in self.best.items():
            for end in STATES:
                more = segment["costs"][state * 4 + end]
                if more >= 0:
                    weight = ((cost + more) * 4 + order) * 4 + segment["orders"][state * 4 + end]
                    if end not in found or weight < found[end][0]:
                        found[end] = weight, state
        self.back.append({end: state for end, (_, state) in found.items()})
        ranked = sorted(found, key=lambda end: found[end][0] % 16)
        self.best = {end: (found[end][0] // 16, ranked.index(end)) for end in found}
        for name in self.totals:
            self.totals[name] += segment[name]
        if self.last_initial is not None:
            self.totals["illegal"] += not legal(self.last_initial, segment["first_initial"])
        self.last_initial = segment["last_initial"]
        if segment["first_turn"] is not None:
            # A turn that goes on in the next segment is one turn.
            self.totals["turns"] -= segment["first_turn"] == self.last_turn
            if self.first_turn is None:
                self.first_turn = segment["first_turn"]
            self.last_turn = segment["last_turn"]

    def rows(self) -> list[dict]:
        end = min(
            self.best,
            key=lambda q: (self.best[q][0] + INSERT * len(TAIL[q])) * 4 + self.best[q][1],
        )
        gaps = 0
        if self.first_turn is not None:
            gaps = int(self.last_turn - self.first_turn + 1 - self.totals.pop("turns"))
        summary = {
            "gaps": gaps,
            **{name: self.totals[name] for name in ("blank", "duplicate", "truncated", "illegal")},
            "cost": self.best[end][0] + INSERT * len(TAIL[end]),
        }
        out, tail = [], TAIL[end]
        for place in range(len(self.segments) - 1, -1, -1):
            start = self.back[place][end]
            task, number = self.segments[place]
            out.append(
                {"task": task, "number": number, "start": start, "end": end, "tail": tail}
                | {"conv_id": self.conv_id}
                | (summary if place == 0 else dict.fromkeys(summary))
            )
            end, tail = start, ""
        return out


def _joined_up(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: _Path | None = None
        made: list[dict] = []
        for batch in batches:
            for segment in batch.to_pylist():
                if path is None or segment["conv_id"] != path.conv_id:
                    made += path.rows() if path else []
                    path = _Path(segment["conv_id"])
                    if len(made) > 10_000:
                        yield pa.RecordBatch.from_pylist(made, schema)
                        made = []
                path.add(segment)
        made += path.rows() if path else []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@dataclass(frozen=True)
class Repair:
    """``summary``: one row per conversation with ``NUMBERS``. ``pieces``: the letters and the
    rows left of each segment, in order of task and number within a conversation."""

    summary: DataFrame
    pieces: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair conversations given as ``conv_id``, ``turn`` (a whole number), ``role``, ``text``."""
    spark = rows.sparkSession
    order: list[Column | str] = ["conv_id", "turn", "role"]
    ranged = (
        with_faults(rows)
        .repartitionByRange(*order, "digest")
        .sortWithinPartitions(*order, "text")
        .select("conv_id", "turn", "role", "text", "copies", "first", "fault")
    )
    schema = _segment_schema(rows)
    path = scratch_path(spark, "segments")
    ranged.mapInArrow(_segments(to_arrow_schema(schema)), schema).write.parquet(path)
    segments = spark.read.schema(schema).parquet(path)

    chosen_schema = T.StructType(
        [schema["task"], schema["number"], schema["conv_id"]]
        + [T.StructField(name, T.IntegerType()) for name in ("start", "end")]
        + [T.StructField("tail", T.StringType())]
        + [T.StructField(name, T.LongType()) for name in NUMBERS]
    )
    chosen = (
        segments.drop("letters", "rows")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "task", "number")
        .mapInArrow(_joined_up(to_arrow_schema(chosen_schema)), chosen_schema)
    )
    path = scratch_path(spark, "chosen")
    chosen.write.parquet(path)
    chosen = spark.read.schema(chosen_schema).parquet(path)
    summary = chosen.filter(F.col("cost").isNotNull()).select("conv_id", *NUMBERS)
    pieces = (
        segments.select("conv_id", "task", "number", "letters", "rows")
        .join(chosen.select("task", "number", "start", "end", "tail"), ["task", "number"])
        .select(
            "conv_id",
            "task",
            "number",
            F.get("letters", F.col("start") * 4 + F.col("end")).alias("letters"),
            "start",
            "tail",
            "rows",
        )
    )
    out = T.StructType(
        [schema["conv_id"], schema["task"], schema["number"]]
        + [T.StructField("audit", T.StringType())]
        + [T.StructField("rows", T.ArrayType(T.StructType(_ROW.fields[:2])))]
    )
    return Repair(summary, pieces.mapInArrow(_applied(to_arrow_schema(out)), out))


def _applied(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                made = []
                for piece in batch.slice(start, 256).to_pylist():
                    letters = piece["letters"] + piece["tail"]
                    made.append(
                        {name: piece[name] for name in ("conv_id", "task", "number")}
                        | {"audit": letters}
                        | {
                            "rows": [
                                {"role": role, "text": text}
                                for role, text in edited(piece["rows"], letters, piece["start"])
                            ]
                        }
                    )
                yield pa.RecordBatch.from_pylist(made, schema)

    return run
