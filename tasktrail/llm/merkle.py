"""Document fingerprints: Merkle trees over words, paragraphs and sections.

The leaves of a tree are words with the white space after them. A node ends where the
hash of the last two words ends in enough zero bits, so the bounds depend on the text
alone, move along with it, and those of a level are also bounds of all levels below. A
word that is repeated at once is no bound. The end of a line is a bound of at least the
paragraph level, a blank line of the section level. A node's hash covers the hashes of
its children in order.

A fingerprint is the root, the number of the lowest level with at most ``NODES`` nodes,
and that level's nodes with the level at which each one's end stops being a bound. Equal
texts have equal roots. The root covers that level and a digest of all leaves; the levels below it down to the words
stay with the fingerprint as its tree and are not part of its text.

Two trees are compared from the level at which both have at most ``NODES`` nodes
downwards: a node that both have is common with all below it, and only the others are
opened. ``differing`` opens them down to the words, which are the edits. The likeness is
twice the bytes under common nodes over all bytes. It opens nodes down to level ``LOWEST``,
some two words whatever the length of the text, so equal rates of edits give equal
likeness, and most single words that unrelated texts share do not count.

A fingerprint read back as text has no tree. It is compared by its listed nodes alone, each
counted once, so that likeness falls with the length of the text; ``near_edited`` and
``near_next`` of ``fingerprint_pairs`` come from whole trees.

Null texts count as empty; an empty text has no node, is like another empty one and
unlike all others. The next document of the last is the first; a single document is its
own next. A null id comes before all others; rows of equal id follow the hash of their
text. Repeated rows follow each other. No row gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasktrail.llm.anchors import Hashes
from tasktrail.llm.common import documents_of

NODES = 64
HASH_BITS = 40
PARAGRAPH, SECTION, TOP = 5, 8, 15
MOST_CHILDREN = 8
LOWEST = 1
DIGITS = HASH_BITS // 4
EMPTY = ":0:"
BATCH_BYTES = 4 << 20
# Up to so many nodes of both sides are compared one by one.
FEW_NODES = 512
# Accuracy of the percentiles that bound the ranges of ids.
PER_RANGE = 20
PACK_LEVEL = 1

_MASK = np.uint64((1 << HASH_BITS) - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def _spans(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last place, first place and length of every run that a bound ends."""
    ends = bound.nonzero()[0]
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    return ends, starts, ends - starts + 1


def _raised(
    hashes: np.ndarray, levels: np.ndarray, level: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of a higher level from those of a lower one, and the place of each first child.

    A node of several children hashes their hashes with their order; one child stays as
    it is, so a node has the same hash on all levels on which it is not joined. No node
    has more than ``MOST_CHILDREN``: a longer run without bounds, as in a text that repeats
    one phrase, is cut by counting from its start.
    """
    bound = levels >= level
    bound[-1] = True
    ends, starts, count = _spans(bound)
    place = np.arange(len(hashes)) - starts.repeat(count)
    if count.max() > MOST_CHILDREN:
        bound |= place % MOST_CHILDREN == MOST_CHILDREN - 1
        ends, starts, count = _spans(bound)
        place = np.arange(len(hashes)) - starts.repeat(count)
    parts = _mix((hashes + np.uint64(1)) * _FACTOR + place.astype(np.uint64))
    joined = _mix(np.add.reduceat(parts, starts) + count.astype(np.uint64)) & _MASK
    return np.where(count == 1, hashes[starts], joined), levels[ends], starts


def _leaves(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, bound level and bytes of every word with its white space."""
    raw = np.frombuffer(data, np.uint8)
    space = raw <= 0x20
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    starts = np.concatenate([[0], starts])
    ends = np.append(starts[1:], len(raw))
    hashes = Hashes(raw).of(starts, ends)
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])
    both = _mix(hashes * _FACTOR + before)
    low = both & (~both + np.uint64(1))
    zeros = np.where(both == 0, 64, np.bitwise_count(low - np.uint64(1))).astype(np.int64)
    lines = np.add.reduceat((raw == 0x0A).astype(np.int64), starts)
    zeros[1:][hashes[1:] == hashes[:-1]] = 0
    levels = np.maximum(zeros, np.where(lines > 1, SECTION, np.where(lines == 1, PARAGRAPH, 0)))
    return hashes & _MASK, np.minimum(levels, TOP), ends - starts


class Tree:
    """All levels of a text that is not empty, from its words to at most ``nodes`` nodes.

    ``hashes`` and ``sizes`` (bytes) hold one array a level, ``starts`` the places of first
    children in the level below; ``levels`` are the bound levels of the highest.
    """

    def __init__(self, text: bytes, nodes: int = NODES):
        hashes, self.levels, sizes = _leaves(text)
        self.hashes, self.sizes, self.starts = [hashes], [sizes], [np.empty(0, np.int64)]
        while len(self.hashes[-1]) > nodes:
            self._raise()

    def _raise(self) -> None:
        hashes, self.levels, starts = _raised(self.hashes[-1], self.levels, len(self.hashes))
        self.hashes.append(hashes)
        self.starts.append(starts)
        self.sizes.append(np.add.reduceat(self.sizes[-1], starts))

    @property
    def top(self) -> int:
        return len(self.hashes) - 1

    def raised(self, level: int) -> Tree:
        """This tree, or one that goes on to a higher level."""
        if level <= self.top:
            return self
        higher = copy(self)
        higher.hashes, higher.sizes, higher.starts = list(self.hashes), list(self.sizes), list(self.starts)
        while higher.top < level:
            higher._raise()
        return higher

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Places in the level below of all children of some nodes."""
        starts = self.starts[level]
        first = starts[nodes]
        count = np.append(starts[1:], len(self.hashes[level - 1]))[nodes] - first
        return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Fingerprint(str):
    """A fingerprint with the tree it was made from."""

    tree: Tree


def _left_over(own: list[int], others: list[int]) -> np.ndarray:
    """``_apart`` for one side of few nodes, where one look each is less than a sort."""
    free = Counter(others)
    apart = np.ones(len(own), bool)
    for place, one in enumerate(own):
        if free.get(one):
            free[one] -= 1
            apart[place] = False
    return apart


def _apart(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is without a counterpart, a hash that stands n times having n at most."""
    if len(one) + len(other) <= FEW_NODES:
        return _left_over(one.tolist(), other.tolist()), _left_over(other.tolist(), one.tolist())
    both = np.concatenate([one, other])
    order = np.argsort(both, kind="stable")
    ordered = both[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    run = np.diff(np.append(first, len(both)))
    mine = np.add.reduceat((order < len(one)).astype(np.int64), first)
    common = np.minimum(mine, run - mine)
    place = np.arange(len(both)) - np.repeat(first, run)
    place -= np.where(order < len(one), 0, np.repeat(mine, run))
    apart = np.empty(len(both), bool)
    apart[order] = place >= np.repeat(common, run)
    return apart[: len(one)], apart[len(one) :]


def _opened(one: Tree, other: Tree, lowest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the nodes that only one or only the other has, and their level.

    From the top down only these are opened, until ``lowest`` or until a side has none.
    """
    level = max(one.top, other.top, lowest)
    one, other = one.raised(level), other.raised(level)
    left, right = np.arange(len(one.hashes[level])), np.arange(len(other.hashes[level]))
    while True:
        mine, its = _apart(one.hashes[level][left], other.hashes[level][right])
        left, right = left[mine], right[its]
        if level == lowest or not len(left) or not len(right):
            return left, right, level
        left, right = one.children(level, left), other.children(level, right)
        level -= 1


def fingerprint(text: str | bytes, nodes: int = NODES) -> str:
    """``root:level:nodes``, each node as its hash and one digit for its bound level."""
    data = text.encode() if isinstance(text, str) else text
    if not data:
        return EMPTY
    tree = Tree(data, nodes)
    hashes, levels, level = tree.hashes[-1], tree.levels, tree.top
    root = hashlib.sha256(hashes.tobytes() + levels.astype(np.uint8).tobytes() + bytes([level]))
    # Nodes have 40 bits, which different texts may share; a digest of the leaves' bytes has 256.
    root.update(hashlib.sha256(data).digest())
    # A node's hash and the digit of its bound level as one number.
    numbers = (hashes << np.uint64(4)) | levels.astype(np.uint64)
    listed = f"%0{DIGITS + 1}x" * len(numbers) % tuple(numbers.tolist())
    mark = Fingerprint(f"{root.hexdigest()[:32]}:{level}:{listed}")
    mark.tree = tree
    return mark


def _parsed(print_: str) -> tuple[int, np.ndarray, np.ndarray]:
    _, level, listed = print_.split(":")
    step = DIGITS + 1
    nodes = [listed[i : i + step] for i in range(0, len(listed), step)]
    hashes = np.array([int(node[:-1], 16) for node in nodes], np.uint64)
    return int(level), hashes, np.array([int(node[-1], 16) for node in nodes], np.int64)


def differing(one: str, other: str) -> tuple[list[int], list[int], int]:
    """Places of words that only one or only the other has, and the number of common words.

    Without the trees: of listed nodes instead of words.
    """
    if one == EMPTY or other == EMPTY:
        left, right = (
            len(p.tree.hashes[0]) if isinstance(p, Fingerprint) else len(_parsed(p)[1]) if p != EMPTY else 0
            for p in (one, other)
        )
        return list(range(left)), list(range(right)), 0
    if isinstance(one, Fingerprint) and isinstance(other, Fingerprint):
        left, right, level = _opened(one.tree, other.tree, 0)
        trees = [tree.raised(level) for tree in (one.tree, other.tree)]
        while level:
            left, right = trees[0].children(level, left), trees[1].children(level, right)
            level -= 1
        return left.tolist(), right.tolist(), len(one.tree.hashes[0]) - len(left)
    parsed = [_parsed(one), _parsed(other)]
    top = max(parsed[0][0], parsed[1][0])
    raised = []
    for level, hashes, levels in parsed:
        while level < top:
            level += 1
            hashes, levels, _ = _raised(hashes, levels, level)
        raised.append(hashes)
    left, right = _apart(*raised)
    return np.flatnonzero(left).tolist(), np.flatnonzero(right).tolist(), int((~left).sum())


def likeness(one: str, other: str) -> float:
    """From 0, no node in common, to 1, equal."""
    if one == other:
        return 1.0
    if isinstance(one, Fingerprint) and isinstance(other, Fingerprint):
        left, right, level = _opened(one.tree, other.tree, LOWEST)
        total = int(one.tree.sizes[0].sum() + other.tree.sizes[0].sum())
        trees = [tree.raised(level) for tree in (one.tree, other.tree)]
        apart = int(trees[0].sizes[level][left].sum() + trees[1].sizes[level][right].sum())
        return (total - apart) / total
    left, right, common = differing(one, other)
    total = len(left) + len(right) + 2 * common
    return 2 * common / total if total else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first characters of another."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_RANGED = "part long, wrap int, at long, tie long, ghost boolean, doc_id long, packed binary"
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_LOWEST = -(1 << 63)


Key = tuple[int, int]


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows in order of id, and of ids with very many rows also of their texts' hash.

    ``bounds`` are the lower ends of all ranges but the first, ``parts`` the numbers of the ranges
    with rows and ``firsts`` their first keys.
    """

    heavy: frozenset[int]
    bounds: list[Key]
    parts: list[int]
    firsts: list[Key]

    def key(self, at: int, tie: int) -> Key:
        return at, tie if at in self.heavy else _LOWEST

    def part(self, key: Key) -> int:
        return bisect_right(self.bounds, key)


def _ranges(rows: DataFrame) -> Ranges:
    """About as many ranges of ``rows`` (``at``, ``tie``) as shuffle partitions."""
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fractions = [i / wanted for i in range(1, wanted)]
    found: list[int] = []
    if fractions:
        cut = F.percentile_approx("at", fractions, wanted * PER_RANGE)
        found = rows.agg(cut.alias("cut")).first()["cut"] or []
    # An id that fills whole ranges is cut by the hash of its texts as often.
    times = {at: n for at, n in Counter(found).items() if n > 1}
    bounds = {(at, _LOWEST) for at in found}
    if times:
        cut = F.percentile_approx("tie", fractions, wanted * PER_RANGE)
        cuts = rows.filter(F.col("at").isin(list(times))).groupBy("at").agg(cut.alias("cut"))
        for row in cuts.collect():
            step = wanted / (times[row["at"]] + 1)
            bounds |= {
                (row["at"], row["cut"][int(i * step)])
                for i in range(1, times[row["at"]] + 1)
                if int(i * step) < len(row["cut"])
            }
    ranges = Ranges(frozenset(times), sorted(bounds), [], [])

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[int, Key] = {}
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = ranges.part(key)
                if part not in first or key < first[part]:
                    first[part] = key
            columns = ([*first], [at for at, _ in first.values()], [tie for _, tie in first.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in columns], ["part", "at", "tie"]
            )

    # Texts are read here only for the ids that are cut.
    tie = F.when(F.col("at").isin(list(times)), F.col("tie")).otherwise(_LOWEST) if times else F.lit(_LOWEST)
    firsts = (
        rows.select("at", tie.alias("tie"))
        .mapInArrow(least, "part long, at long, tie long")
        .groupBy("part")
        .agg(F.min(F.struct("at", "tie")).alias("first"))
        .collect()
    )
    firsts = sorted((row["part"], tuple(row["first"])) for row in firsts)
    return replace(ranges, parts=[part for part, _ in firsts], firsts=[key for _, key in firsts])


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness to the latter
    and to the next document."""
    rows = documents_of(docs).select(
        F.coalesce("doc_id", F.lit(_LOWEST)).alias("at"),
        F.xxhash64("text").alias("tie"),
        "doc_id",
        "text",
    )
    ranges = _ranges(rows.select("at", "tie"))
    parts, firsts = ranges.parts, ranges.firsts
    before = {first: part for first, part in zip(firsts[1:], parts[:-1])}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        packer = ZstdCompressor(level=PACK_LEVEL)
        for batch in batches:
            rows: list[tuple] = []
            for index, line in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = batch.column(3)[index].as_py().encode()
                rest = (batch.column(2)[index].as_py(), packer.compress(text))
                key = ranges.key(*line)
                rows.append((ranges.part(key), 0, *line, False, *rest))
                # The first row of a range also ends the range before it.
                if key in before:
                    rows.append((before[key], 0, *line, True, *rest))
                if key == firsts[0]:
                    rows.append((parts[-1], 1, *line, True, *rest))
            if rows:
                yield _dealt(rows)

    return (
        rows.mapInArrow(deal, _RANGED)
        .repartitionById(len(ranges.bounds) + 1, F.col("part").cast("int"))
        .sortWithinPartitions("part", "wrap", "at", "tie", "ghost")
        .mapInArrow(_walk, _RESULT)
    )


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    names = ["part", "wrap", "at", "tie", "ghost", "doc_id", "packed"]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names
    )


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document meets the row after it; the last rows of a range are only met."""
    from zstandard import ZstdDecompressor

    unpacker = ZstdDecompressor()
    part, waiting = None, None
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        parts, ghosts = batch.column(0).to_pylist(), batch.column(4).to_pylist()
        for index, (own, ghost) in enumerate(zip(parts, ghosts)):
            if own != part:
                part, waiting = own, None
            if ghost and waiting is None:
                continue
            text = unpacker.decompress(batch.column(6)[index].as_py()).decode()
            mark = fingerprint(text)
            if waiting is not None:
                doc_id, earlier, its_mark = waiting
                changed = edited(earlier, text).encode()
                changed_mark = fingerprint(changed)
                rows.append(
                    (
                        doc_id,
                        len(earlier),
                        hashlib.sha256(changed).hexdigest(),
                        str(its_mark),
                        str(changed_mark),
                        likeness(its_mark, changed_mark),
                        likeness(its_mark, mark),
                    )
                )
                held += len(its_mark) + len(changed_mark)
                if held > BATCH_BYTES:
                    yield _result(rows)
                    rows, held = [], 0
            waiting = None if ghost else (batch.column(5)[index].as_py(), text, mark)
    if rows:
        yield _result(rows)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)
    names = [part.split()[0] for part in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names
    )
