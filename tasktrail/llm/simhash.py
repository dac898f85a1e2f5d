"""SimHash near-duplicates by a binary trie self-join.

Every text gets a 64-bit fingerprint over its word shingles; fingerprints within a few
bits are linked, and linked documents form a component.

Equal fingerprints are one node. The distinct ones are dealt to groups so that every pair
within the distance meets: with 6 blocks and at most 4 differing bits two blocks are
equal, so a fingerprint goes once to each of the 15 choices of two blocks, together with
those that agree there. Within a group the fingerprints form a binary trie. Node pairs
are walked down together from the root with itself; the bits in which they differ add up,
and a pair over the budget is dropped with all below. A node is a range of the sorted
fingerprints, so all pairs of one level are one vector operation.

A group of more than ``GROUP_LIMIT`` fingerprints is dealt again by the bits that its
members do not share yet, as often as needed; once ``LAST_BITS`` bits are left, a group
of distinct fingerprints holds at most 2 to that power, whatever the input. No pair is
lost, and no list of pairs is made: each group returns at most one link per member.

Null texts and texts without words have the fingerprint zero and are linked like others.
Rows with a null id get a component but never name one, unless all its ids are null.
Repeated rows repeat in the result. No row gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasktrail.llm.common import documents_of, free_name, released, slices, written
from tasktrail.llm.components import components

BITS = 64
SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
# Blocks that must be equal, beyond the budget's number of blocks that may differ.
EQUAL_BLOCKS = 2
GROUP_LIMIT = 4096
LAST_BITS = 19
# Node pairs that are walked at a time.
PAIRS_AT_A_TIME = 400_000

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text: bits set in over half the hashes of its shingles."""
    from xxhash import xxh64_digest

    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = b"".join(
        [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]
    )
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(rows), 65_535):
        part = np.unpackbits(rows[begin : begin + 65_535], axis=1)
        ones += part.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text) and ``fp``, the fingerprint as a signed integer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).cast(pa.binary())
            found = np.array([fingerprint(one.as_py(), words) for one in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                ["doc_id", "tie", "fp"],
            )

    rows = documents_of(docs).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(released(run), "doc_id long, tie long, fp long")


def block_masks(free: int, distance: int) -> list[int]:
    """Masks of the free bits of which one at least is equal for every pair within the distance."""
    places = [bit for bit in reversed(range(BITS)) if (free >> bit) & 1]
    count = distance + EQUAL_BLOCKS
    blocks = [sum(1 << int(bit) for bit in part) for part in np.array_split(places, count)]
    return [sum(chosen) for chosen in combinations(blocks, EQUAL_BLOCKS)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


class TrieJoin:
    """Links among fingerprints that agree in the bits of ``mask``; groups are walked together.

    ``values`` are distinct and sorted by their masked bits, then in full.
    """

    def __init__(self, values: np.ndarray, mask: int, distance: int):
        self.values = values
        self.mask = np.uint64(mask)
        self.distance = distance
        self.label = np.arange(len(values))
        self.bits = [bit for bit in reversed(range(BITS)) if not (mask >> bit) & 1]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Members and the first member they are linked with, directly or through others."""
        shared = self.values & self.mask
        edges = np.concatenate([[0], np.flatnonzero(shared[1:] != shared[:-1]) + 1, [len(shared)]])
        low, high = edges[:-1], edges[1:]
        several = high - low > 1
        low, high = low[several], high[several]
        self.ones: dict[int, np.ndarray] = {}
        stack = [(0, low, high, low, high, np.zeros(len(low), np.int8))]
        while stack:
            level, *pairs = stack.pop()
            if len(pairs[0]) > PAIRS_AT_A_TIME:
                middle = len(pairs[0]) // 2
                stack.append((level, *(one[middle:] for one in pairs)))
                stack.append((level, *(one[:middle] for one in pairs)))
            elif len(pairs[0]) and level < len(self.bits):
                stack.append((level + 1, *self._down(level, *pairs)))
        member = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.values[member], self.values[self.label[member]]

    def _ones(self, level: int) -> np.ndarray:
        """How many values before each place have the bit of a level."""
        if level not in self.ones:
            bit = ((self.values >> np.uint64(self.bits[level])) & np.uint64(1)).astype(np.int32)
            self.ones[level] = np.concatenate([[0], np.cumsum(bit)])
        return self.ones[level]

    def _down(self, level, low1, high1, low2, high2, differing):
        """The children of node pairs that may still hold a link; links found are united."""
        ones = self._ones(level)
        cut1 = high1 - (ones[high1] - ones[low1])
        cut2 = high2 - (ones[high2] - ones[low2])
        same = low1 == low2
        other = ~same
        pairs = [
            np.concatenate(column)
            for column in zip(
                (low1, cut1, low2, cut2, differing),
                (cut1, high1, cut2, high2, differing),
                (low1, cut1, cut2, high2, differing + 1),
                (cut1[other], high1[other], low2[other], cut2[other], differing[other] + 1),
            )
        ]
        low1, high1, low2, high2, differing = pairs
        size1, size2 = high1 - low1, high2 - low2
        live = (size1 > 0) & (size2 > 0) & (differing <= self.distance)
        live &= ~((low1 == low2) & (size1 == 1))
        leaves = live & (size1 == 1) & (size2 == 1)
        if leaves.any():
            a, b = low1[leaves], low2[leaves]
            near = np.bitwise_count(self.values[a] ^ self.values[b]) <= self.distance
            self._unite(a[near], b[near])
        # All below differ in too few bits to matter: link the members of both nodes.
        close = live & ~leaves & (differing + (len(self.bits) - level - 1) <= self.distance)
        for a, b, c, d in zip(low1[close], high1[close], low2[close], high2[close]):
            members = np.concatenate([np.arange(a, b), np.arange(c, d)])
            self._unite(members, np.full(len(members), members[0]))
        live &= ~leaves & ~close
        return low1[live], high1[live], low2[live], high2[live], differing[live]

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give linked members the smallest label of either."""
        label = self.label
        while len(a):
            one, two = label[a], label[b]
            apart = one != two
            a, b, one, two = a[apart], b[apart], one[apart], two[apart]
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label[:] = shorter


def _join_groups(distance: int):
    """Links of whole groups: rows come sorted by mask, shared bits and fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_mask, rest = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            masks = np.concatenate([rest_mask, batch.column(0).to_numpy()])
            values = np.concatenate([rest, batch.column(1).to_numpy().view(np.uint64)])
            if not len(masks):
                continue
            # The last group may go on in the next batch.
            shared = values & masks.view(np.uint64)
            changes = np.flatnonzero((shared[1:] != shared[:-1]) | (masks[1:] != masks[:-1]))
            whole = int(changes[-1]) + 1 if len(changes) else 0
            yield from joined(masks[:whole], values[:whole])
            rest_mask, rest = masks[whole:], values[whole:]
        yield from joined(rest_mask, rest)

    def joined(masks: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate([[0], np.flatnonzero(masks[1:] != masks[:-1]) + 1, [len(masks)]])
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if end - begin > 1:
                mask = int(masks[begin : begin + 1].view(np.uint64)[0])
                a, b = TrieJoin(values[begin:end], mask, distance).links()
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                    )

    return run


def trie_links(nodes: DataFrame, distance: int = DISTANCE, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints ``fp`` within the distance."""
    spark = nodes.sparkSession
    full = (1 << BITS) - 1
    masks = block_masks(full, distance)
    dealt = nodes.select(
        F.explode(F.array(*(F.lit(_signed(mask)) for mask in masks))).alias("mask"), "fp"
    )
    found = []
    while True:
        key = ["mask", F.col("fp").bitwiseAND(F.col("mask")).alias("shared")]
        dealt = dealt.select(*key, "fp")
        masks = [mask for mask in masks if BITS - mask.bit_count() > LAST_BITS]
        deeper = [
            (_signed(mask), _signed(mask | more))
            for mask in masks
            for more in block_masks(full & ~mask, distance)
        ]
        hot = None
        if deeper:
            large = dealt.groupBy("mask", "shared").count().filter(F.col("count") > limit)
            hot = written(
                large.filter(F.col("mask").isin([_signed(mask) for mask in masks])).drop("count"),
                "large-groups",
            )
            if hot.isEmpty():
                hot = None
        here = dealt if hot is None else dealt.join(hot, ["mask", "shared"], "left_anti")
        # Unsigned order: zeros before ones in every bit.
        unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << (BITS - 1))))
        sorted_ = here.repartition("mask", "shared").sortWithinPartitions("mask", "shared", unsigned)
        found.append(sorted_.select("mask", "fp").mapInArrow(_join_groups(distance), "a long, b long"))
        if hot is None:
            break
        again = spark.createDataFrame(deeper, "mask long, _deeper long")
        inside = written(dealt.join(hot, ["mask", "shared"], "left_semi"), "large-members")
        dealt = inside.join(F.broadcast(again), "mask").select(
            F.col("_deeper").alias("mask"), "fp"
        ).distinct()
        masks = sorted({deep & full for _, deep in deeper})
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE
) -> DataFrame:
    """``doc_id``, ``tie``, ``fp``, ``component_id`` (the smallest id of all documents reachable)
    and ``stays``, true for the rows that stand for their component.

    These are the rows with the smallest id, or of several such the smallest hash of the
    text: one row, unless it is repeated.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    nodes = written(rows.groupBy("fp").agg(first.alias("first")), "nodes")
    roots = components(trie_links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("of_all"))
    classes = written(rooted.join(smallest, "root").select("fp", "of_all"), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("of_all.doc_id")) & (F.col("tie") == F.col("of_all.tie"))
    return rows.join(classes, "fp").select(
        "doc_id", "tie", "fp", F.col("of_all.doc_id").alias("component_id"), stays.alias("stays")
    )


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all columns of ``docs``."""
    found = near_duplicates(docs, words, distance).filter("stays")
    at, tie = free_name(docs, "at"), free_name(docs, "tie")
    lowest = F.lit(-(1 << (BITS - 1)))
    kept = found.select(F.coalesce("doc_id", lowest).alias(at), F.col("tie").alias(tie))
    named = docs.withColumns(
        {
            at: F.coalesce(F.col("doc_id").cast("long"), lowest),
            tie: F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
    )
    return named.join(kept, [at, tie], "left_semi").dropDuplicates([at, tie]).drop(at, tie)
