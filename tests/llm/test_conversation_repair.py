"""Repairs against all edit sequences of small conversations and a plain table DP."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tasktrail.llm import conversation_repair as repairs
from tasktrail.llm.conversation_repair import cheapest, damaged, repair
from tasktrail.llm.queries import op13_conversation_repair

GOAL = re.compile(r"(s?(ua)+)?")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """Fault of each (role, text), by its plain definition."""
    found, seen = [], set()
    for role, text in rows:
        marks = VISIBLE.findall(text)
        if not marks:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        elif marks[-1] not in ".!?":
            found.append("truncated")
        else:
            found.append("")
        seen.add((role, text))
    return found


def all_edits(rows):
    """The least (cost, letters) by best-first search over letters, and what it leaves."""
    wrong = faults(rows)
    # Cost, letters, place, initials so far, rows left.
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, letters, place, initials, left = heapq.heappop(heap)
        if place == len(rows) and GOAL.fullmatch(initials):
            return cost, letters, list(left)
        if not re.fullmatch(r"(s?(ua)*u?)?", initials):
            continue
        if letters[-3:] != "III":
            for role in ("user", "assistant"):
                heapq.heappush(
                    heap,
                    (cost + 3, letters + "I", place, initials + role[0], left + ((role, ""),)),
                )
        if place < len(rows):
            role, text = rows[place]
            heapq.heappush(heap, (cost + 4, letters + "D", place + 1, initials, left))
            if wrong[place] in ("blank", "duplicate"):
                continue
            more = 3 if wrong[place] == "truncated" else 0
            heapq.heappush(
                heap,
                (cost + more, letters + "K", place + 1, initials + (role[:1] or "-"), left + ((role, text),)),
            )
            for to in ("user", "assistant"):
                heapq.heappush(
                    heap,
                    (cost + more + 3, letters + "R", place + 1, initials + to[0], left + ((to, text),)),
                )


def expected_of(rows):
    """Summary of one conversation's rows (turn, role, text) in order."""
    plain = [(role, text) for _, role, text in rows]
    cost, letters, left = all_edits(plain)
    wrong = faults(plain)
    turns = {turn for turn, *_ in rows if turn is not None}
    initials = [role[:1] for role, _ in plain]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        wrong.count("blank"),
        wrong.count("duplicate"),
        wrong.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        letters,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
    )


def in_order(rows):
    return sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2].encode()))


def found_of(rows, spark):
    """The operator's summary, audit and text per conversation."""
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = repair(frame.repartition(3))
    pieces = sorted(made.pieces.collect(), key=lambda p: (p.task, p.number))
    found = {}
    for row in made.summary.collect():
        own = [piece for piece in pieces if piece.conv_id == row.conv_id]
        text = "\n".join(f"{r.role}:{r.text}" for piece in own for r in piece.rows)
        found[row.conv_id] = (
            *row[1:],
            "".join(piece.audit for piece in own),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return found


def random_conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No!", "well", " ", "", "So? ", "a b c.\t", "x\n"])
            at = None if rng.random() < 0.1 else turn + rng.choice([0, 0, 0, 3])
            rows.append((conv, at, role, text))
    return rows


def expected_by_conversation(rows):
    found = {}
    for conv in {row[0] for row in rows}:
        found[conv] = expected_of(in_order([row[1:] for row in rows if row[0] == conv]))
    return found


def test_against_all_edit_sequences(spark):
    rows = random_conversations(1, 150, 6)
    assert found_of(rows, spark) == expected_by_conversation(rows)


def test_short_segments_change_nothing():
    rows = random_conversations(2, 40, 7)
    conversations = {}
    for conv in {row[0] for row in rows}:
        own = in_order([row[1:] for row in rows if row[0] == conv])
        symbols = [(kind_of(fault), role[:1]) for fault, (_, role, _) in zip(faults([r[1:] for r in own]), own)]
        path = repairs._Path(conv)
        segments = []
        for number, start in enumerate(range(0, len(own), 2)):
            part = [(*row, kind) for row, (kind, _) in zip(own[start : start + 2], symbols[start : start + 2])]
            segments.append(repairs._segment(conv, 0, number, part))
            path.add(segments[-1])
        pieces = sorted(path.rows(), key=lambda piece: piece["number"])
        letters = [
            segments[p["number"]]["letters"][p["start"] * 4 + p["end"]] + p["tail"] for p in pieces
        ]
        left = [
            row
            for p, own_letters in zip(pieces, letters)
            for row in repairs.edited(segments[p["number"]]["rows"], own_letters, p["start"])
        ]
        text = "\n".join(f"{r}:{t}" for r, t in left)
        numbers = [pieces[0][name] for name in repairs.NUMBERS]
        conversations[conv] = (
            *numbers, "".join(letters), hashlib.sha256(text.encode()).hexdigest(),
        )
    assert conversations == expected_by_conversation(rows)


def kind_of(fault):
    return {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[fault]


def test_every_short_conversation_of_symbols():
    symbols = list(product(range(4), "suat"))
    rng = random.Random(4)
    for size in range(5):
        for _ in range(200):
            rows = [rng.choice(symbols) for _ in range(size)]
            ends = cheapest(rows, repairs.START)
            offers = [
                (cost + 3 * len(repairs.TAIL[q]), letters + repairs.TAIL[q])
                for q, (cost, letters) in ends.items()
            ]
            assert min(offers) == plain_table(rows)


def plain_table(rows):
    """Least (cost, letters) by comparing whole strings, over many insertions."""
    best = {"": (0, "")}

    def offer(table, initials, value):
        if re.fullmatch(r"(s?(ua)*u?)?", initials):
            state = ("s" if initials == "s" else initials[-1:]) if initials else ""
            if state not in table or value < table[state]:
                table[state] = value

    def grown(state, role):
        return {"": "", "s": "s", "u": "u", "a": "ua"}[state] + role

    def step(table):
        for _ in range(4):
            for state, (cost, letters) in list(table.items()):
                for role in "ua":
                    offer(table, grown(state, role), (cost + 3, letters + "I"))
        return table

    for fault, initial in rows:
        table = {}
        for state, (cost, letters) in step(best).items():
            offer(table, {"": "", "s": "s", "u": "u", "a": "ua"}[state], (cost + 4, letters + "D"))
            if fault in (1, 2):
                continue
            more = 3 if fault == 3 else 0
            offer(table, grown(state, initial), (cost + more, letters + "K"))
            for role in "ua":
                offer(table, grown(state, role), (cost + more + 3, letters + "R"))
        best = table
    best = step(best)
    return min(value for state, value in best.items() if state in ("", "a"))


def test_a_long_conversation_spreads_over_segments(spark):
    rows = [(7, turn, "user" if turn % 3 else "assistant", f"text {turn}.") for turn in range(3000)]
    found = found_of(rows, spark)[7]
    symbols = [(0, role[:1]) for _, _, role, _ in rows]
    ends = cheapest(symbols, repairs.START)
    offers = [(c + 3 * len(repairs.TAIL[q]), a + repairs.TAIL[q]) for q, (c, a) in ends.items()]
    assert found[5:7] == min(offers)


def test_many_copies_of_one_row(spark):
    rows = [(1, 5, "user", "Same.")] * 1500 + [(1, 6, "assistant", "Yes.")]
    found = found_of(rows, spark)[1]
    assert found[:6] == (0, 0, 1499, 0, 1499, 4 * 1499)
    assert found[6] == "K" + "D" * 1499 + "K"


def test_nulls_and_empty_tables(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yo."),
        (1, None, "user", "A."), (1, None, None, "B."), (2, None, "user", None),
    ]
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert found_of(rows, spark) == expected_by_conversation(plain)
    assert found_of([], spark) == {}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_over_the_given_table(spark, folder):
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = []
    for row in conversations.collect():
        name = ":".join(" " if part is None else str(part) for part in (row.conv_id, row.turn))
        case = zlib.crc32(name.encode()) % 20
        role, text = (" " if part is None else part for part in (row.role, row.text))
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        rows += [(row.conv_id, row.turn, role, text)] * (2 if case == 3 else 1)
    assert sorted(map(tuple, damaged(conversations).collect())) == sorted(rows)
    expected = expected_by_conversation(rows)
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for row in conversations.select("conv_id").distinct().collect():
        expected.setdefault(row.conv_id, gone)
    found = {row[0]: tuple(row[1:]) for row in op13_conversation_repair(spark, folder).collect()}
    assert found == expected


def test_columns_of_the_query_do_not_clash(spark):
    frame = spark.createDataFrame(
        [(1, 0, "user", "Hi.", 1, 2, "x")],
        "conv_id long, turn long, role string, text string, copies int, first int, fault string",
    )
    made = repair(frame)
    assert [tuple(row) for row in made.summary.collect()] == [(1, 0, 0, 0, 0, 0, 3)]
    assert made.pieces.select(F.size("rows")).first()[0] == 2
