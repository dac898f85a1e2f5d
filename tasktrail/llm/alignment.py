"""Alignment of two tokenizers by inverted pair bitmaps.

A reads a space and the text, B (which adds a space itself) the text. Where a token of A and
a token of B end at the same byte, both sides are cut; the tokens between two such cuts are
a group, and every occurrence of A in a group is linked with every occurrence of B in it.

``align`` reads each text once and keeps two kinds of rows in one written table:

- a row per document with its numbers and its groups as text;
- postings, an inverted index of id pairs: documents are numbered within blocks of bounded
  size, and for each pair that a block holds, plane 0 is the compressed bitmap of documents
  that hold the pair, plane k >= 1 the bitmap of those whose number of links less one has
  the binary digit 2**(k-1). A bitmap is a sorted list of 16-bit numbers or, where that
  would be longer, one bit per document of the block.

Bitmaps of one block are OR-merged as its texts are read; the blocks of a pair hold different
documents, so the OR over blocks is the union of their containers, and its popcount the sum of
theirs. ``pairs`` holds these sums: documents per pair from plane 0, links per pair from all
planes by their weight. ``scores`` sends them back along the postings: each document gets
the sum over its links of the pair's document count, and the number of its links whose count
is the highest of their A id.

A pair has at most one row per block and plane, so a frequent pair never gathers in one task.
Links of a group beyond ``WIDE_GROUP`` are counted by the product of the multiplicities of
its ids, never written one by one. Texts are cut in front of white space that starts with a
space or a line feed behind a visible character, where both tokenizers always cut; each
distinct part of a block is encoded and aligned once.

Null and empty texts and texts whose token bytes do not join to the text again (for B those
that hold its space mark) have no tokens, and zeros. Repeated rows are documents of their
own. Rows are told apart by block and place, so null or repeated ids do no harm.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tasktrail.llm.chunk_tokens import ChunkEncoder, _byte_letters
from tasktrail.llm.common import documents_of, release, released, scratch_path

# A block ends with the document that reaches either bound; places fit 16 bits. A worker holds
# one block, its tokens and its postings, some 60 bytes a character.
BLOCK_DOCUMENTS = 1 << 15
BLOCK_CHARACTERS = 2 << 20
# Parts are aligned together up to about so many bytes.
BATCH_BYTES = 1 << 19
# Links of larger groups are counted by multiplicities.
WIDE_GROUP = 256

ROWS = (
    "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups string, a int, b int, plane int, n int, dense boolean, places binary"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema(
    [(name, _TYPES.get(kind, pa.binary())) for name, kind in map(str.split, ROWS.split(", "))]
)
# Behind each token of the groups as text: more of the same side, the other side, a new group.
_MORE, _OTHER, _NEXT = ",", "|", ";"


class Aligner:
    """Tokens and their bytes under both tokenizers. Built once per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = spec["pre_tokenizer"]
        if (
            spec["normalizer"]
            or splitter["type"] != "ByteLevel"
            or splitter["add_prefix_space"]
            or not splitter["use_regex"]
        ):
            raise ValueError(f"{a_path} is not a plain byte-level tokenizer")
        plain = Tokenizer.from_file(a_path)
        plain.no_truncation()
        plain.no_padding()
        plain.encode_special_tokens = True
        self.a = ChunkEncoder(a_path)
        self.a.tokenizer = plain
        byte_of = {chr(letter): byte for byte, letter in _byte_letters().items()}
        vocabulary = plain.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(byte_of[letter] for letter in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)])
            if self.b.is_byte(i)
            else piece.replace("\u2581", " ").encode()
            for i, piece in pieces
        ]
        if any("\n" in piece or re.search("[^\u2581]\u2581", piece) for _, piece in pieces):
            raise ValueError(f"{b_path} has pieces over the end of a word or line")
        self.space = self.b.piece_to_id("\u2581")
        self.a_lengths = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_lengths = np.fromiter(map(len, self.b_bytes), np.int64)
        ids = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{i}{mark}" for i in range(ids) for mark in (_MORE, _OTHER, _NEXT)]

    def tokens(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Ids of A and B of all parts and how many each has; which parts have none, since the
        bytes of their tokens are not their own."""
        ids_a = self.a.encoded(parts)
        n_a = np.fromiter(map(len, ids_a), np.int64, len(parts)) // 4
        a = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64)
        # The library puts a space in front of all but an empty text: parts bring their own,
        # but for those that begin with a line feed, in front of which the added space is a
        # piece of its own.
        texts = [part.decode() for part in parts]
        ids_b = self.b.encode([text[text[:1] == " " :] for text in texts])
        ids_b = [[self.space] if text == " " else ids for text, ids in zip(texts, ids_b)]
        n_b = np.fromiter(map(len, ids_b), np.int64, len(parts))
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        added = np.fromiter((text[:1] != " " for text in texts), bool, len(parts))
        kept = np.ones(len(b), bool)
        kept[(np.cumsum(n_b) - n_b)[added]] = False
        b, n_b = b[kept], n_b - added
        broken = np.zeros(len(parts), bool)
        for ids, counts, lengths, table in (
            (a, n_a, self.a_lengths, self.a_bytes),
            (b, n_b, self.b_lengths, self.b_bytes),
        ):
            joined = b"".join(map(table.__getitem__, ids.tolist()))
            ends = np.cumsum(per_text(lengths[ids], counts)).tolist()
            sizes = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))).tolist()
            if ends != sizes or joined != b"".join(parts):
                start = 0
                for i, end in enumerate(ends):
                    broken[i] |= joined[start:end] != parts[i]
                    start = end
        if broken.any():
            a, b = a[~np.repeat(broken, n_a)], b[~np.repeat(broken, n_b)]
            n_a, n_b = np.where(broken, 0, n_a), np.where(broken, 0, n_b)
        return a, n_a, b, n_b, broken


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    key = a_path, b_path
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``sizes`` of them per text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


@dataclass(frozen=True)
class Parts:
    """Numbers, groups and links of parts of texts; ``reach`` pairs belong to each part."""

    broken: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    reach: np.ndarray
    pair: np.ndarray
    links: np.ndarray

    @classmethod
    def of(cls, tool: Aligner, parts: list[bytes]) -> Parts:
        a, n_a, b, n_b, broken = tool.tokens(parts)
        # Both sides have the same bytes, so offsets over all parts match as those of one do.
        ends_a, ends_b = np.cumsum(tool.a_lengths[a]), np.cumsum(tool.b_lengths[b])
        cut_a = np.isin(ends_a, ends_b, assume_unique=True)
        cut_b = np.isin(ends_b, ends_a, assume_unique=True)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_groups = per_text(cut_a, n_a)
        total = int(n_groups.sum())
        held_a = np.bincount(group_a, minlength=total)
        held_b = np.bincount(group_b, minlength=total)
        part = np.repeat(np.arange(len(parts)), n_groups)
        reach, pair, links = cls._links(len(tool.b_bytes), a, b, group_a, held_a, held_b, part)
        return cls(
            broken,
            n_a,
            n_b,
            n_groups,
            per_text(held_a * held_b, n_groups),
            cls._groups(tool.names, a, b, group_a, group_b, n_groups),
            np.bincount(reach, minlength=len(parts)),
            pair,
            links,
        )

    @staticmethod
    def _groups(names, a, b, group_a, group_b, n_groups) -> list[str]:
        """``a1,a2|b1;a3|b2,b3;`` of each part."""
        ids = np.concatenate([a, b])
        group = np.concatenate([group_a, group_b])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side = group[order], side[order]
        mark = np.full(len(ids), 2)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] - side[:-1])
        named = list(map(names.__getitem__, (ids[order] * 3 + mark).tolist()))
        found, start = [], 0
        for end in np.searchsorted(group, np.cumsum(n_groups)).tolist():
            found.append("".join(named[start:end]))
            start = end
        return found

    @staticmethod
    def _links(n_b, a, b, group_a, held_a, held_b, part):
        """Part, id pair and number of links, by part; ``part`` is that of each group."""
        first_a, first_b = np.cumsum(held_a) - held_a, np.cumsum(held_b) - held_b
        wide = held_a * held_b > WIDE_GROUP
        narrow = np.flatnonzero(~wide[group_a])
        group = group_a[narrow]
        reach = held_b[group]
        steps = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        others = b[np.repeat(first_b[group], reach) + steps]
        parts = [np.repeat(part[group], reach)]
        pairs = [np.repeat(a[narrow], reach) * n_b + others]
        links = [np.ones(len(others), np.int64)]
        for one in np.flatnonzero(wide).tolist():
            own_a = Counter(a[first_a[one] : first_a[one] + held_a[one]].tolist())
            own_b = Counter(b[first_b[one] : first_b[one] + held_b[one]].tolist())
            counted = {
                left * n_b + right: times * again
                for left, times in own_a.items()
                for right, again in own_b.items()
            }
            parts.append(np.full(len(counted), part[one]))
            pairs.append(np.fromiter(counted.keys(), np.int64, len(counted)))
            links.append(np.fromiter(counted.values(), np.int64, len(counted)))
        part, pair, link = map(np.concatenate, (parts, pairs, links))
        order = np.argsort(part, kind="stable")
        return part[order], pair[order], link[order]


def parts_of(tool: Aligner, parts: list[bytes]) -> Parts:
    """All parts, aligned in batches of bounded size."""
    made, start, held = [], 0, 0
    for end, part in enumerate(parts, 1):
        held += len(part)
        if held >= BATCH_BYTES or end == len(parts):
            made.append(Parts.of(tool, parts[start:end]))
            start, held = end, 0
    joined = {
        name: np.concatenate([getattr(one, name) for one in made])
        for name in Parts.__dataclass_fields__
        if name != "groups"
    }
    return Parts(**joined, groups=[text for one in made for text in one.groups])


class _Block:
    """Documents of one block."""

    def __init__(self, number: int):
        self.number = number
        self.doc_ids: list[int | None] = []
        self.texts: list[str] = []
        self.characters = 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.doc_ids.append(doc_id)
        self.texts.append(" " + text if text else "")
        self.characters += len(text)

    @property
    def documents(self) -> int:
        return len(self.doc_ids)

    @property
    def full(self) -> bool:
        return self.documents >= BLOCK_DOCUMENTS or self.characters >= BLOCK_CHARACTERS

    def rows(self, tool: Aligner) -> Iterator[pa.RecordBatch]:
        """A row per document, then the bitmaps of places per id pair and plane."""
        codes, first, distinct = tool.a.pieces(pa.array(self.texts, pa.large_string()))
        texts = distinct.to_pylist()
        parts = parts_of(tool, texts) if texts else None
        sizes = np.diff(first)
        place = np.repeat(np.arange(self.documents), sizes)
        if parts is not None and parts.broken.any():
            # One part that does not join to its bytes takes the tokens of its document.
            whole = np.ones(self.documents, bool)
            whole[place[parts.broken[codes]]] = False
            codes, sizes = codes[whole[place]], np.where(whole, sizes, 0)
            place = np.repeat(np.arange(self.documents), sizes)
        names = ("n_a", "n_b", "n_groups", "n_links")
        if parts is None:
            numbers = {name: np.zeros(self.documents, np.int64) for name in names}
        else:
            numbers = {name: per_text(getattr(parts, name)[codes], sizes) for name in names}
        groups, start, listed = [], 0, codes.tolist()
        for end in np.cumsum(sizes).tolist():
            groups.append("".join([parts.groups[code] for code in listed[start:end]])[:-1])
            start = end
        yield self._batch(
            place=np.arange(self.documents, dtype=np.int32),
            doc_id=self.doc_ids,
            **numbers,
            groups=groups,
        )
        del groups, listed
        if len(codes):
            yield from self._postings(len(tool.b_bytes), parts, codes, place)

    def _postings(
        self, n_b: int, parts: Parts, codes: np.ndarray, place: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        # Times of each distinct part per document, then of each pair per document.
        both, times = np.unique(place * len(parts.reach) + codes, return_counts=True)
        place, codes = np.divmod(both, len(parts.reach))
        reach = parts.reach[codes]
        begins = (np.cumsum(parts.reach) - parts.reach)[codes]
        at = np.repeat(begins - (np.cumsum(reach) - reach), reach)
        at += np.arange(len(at))
        # One number a link, and no more of them at a time than the next step reads.
        code, links = parts.pair[at], parts.links[at]
        del at
        code <<= 16
        code |= np.repeat(place, reach)
        links *= np.repeat(times, reach)
        order = np.argsort(code, kind="stable")
        code = code[order]
        links = links[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        rest = np.add.reduceat(links, first) - 1
        del links
        code = code[first]
        del first
        pair, place = code >> 16, (code & 0xFFFF).astype("<u2")
        del code
        yield from self._plane(0, n_b, pair, place)
        for digit in range(int(rest.max()).bit_length()):
            has = (rest >> digit & 1).astype(bool)
            if has.any():
                yield from self._plane(digit + 1, n_b, pair[has], place[has])

    def _batch(self, **columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        columns["block"] = np.full(size, self.number, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(size, field.type)
                if field.name not in columns
                else columns[field.name]
                if isinstance(columns[field.name], pa.Array)
                else pa.array(columns[field.name], field.type)
                for field in _SCHEMA
            ],
            schema=_SCHEMA,
        )

    def _plane(
        self, plane: int, n_b: int, pair: np.ndarray, place: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        """One row per pair; ``pair`` is sorted, ``place`` sorted within a pair."""
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        counts = np.diff(np.append(first, len(pair)))
        own = pair[first]
        dense = counts * 2 > bitmap_bytes(self.documents)
        for wanted in (dense, ~dense):
            rows = np.flatnonzero(wanted)
            if not len(rows):
                continue
            if wanted is dense:
                held = [
                    packed(place[start : start + size], self.documents)
                    for start, size in zip(first[rows].tolist(), counts[rows].tolist())
                ]
                places = pa.array(held, pa.binary())
            else:
                kept = place[np.repeat(wanted, counts)]
                edges = np.concatenate([[0], np.cumsum(counts[rows]) * 2]).astype(np.int32)
                places = pa.BinaryArray.from_buffers(
                    pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(kept)]
                )
            yield self._batch(
                a=(own[rows] // n_b).astype(np.int32),
                b=(own[rows] % n_b).astype(np.int32),
                plane=np.full(len(rows), plane, np.int32),
                n=counts[rows].astype(np.int32),
                dense=np.full(len(rows), wanted is dense),
                places=places,
            )


def bitmap_bytes(documents: int) -> int:
    return (documents + 7) // 8


def packed(places: np.ndarray, documents: int) -> bytes:
    """One bit per document."""
    bits = np.zeros(documents, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(places: bytes, dense: bool) -> np.ndarray:
    """The places of a bitmap, in order."""
    if dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(places, np.uint8), bitorder="little"))
    return np.frombuffer(places, "<u2")


def _read(a_path: str, b_path: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py())
                if block.full:
                    yield from block.rows(tool)
                    block = _Block(block.number + 1)
                    release()
        if block.documents:
            yield from block.rows(tool)

    return read


@dataclass(frozen=True)
class Alignment:
    """What ``align`` found.

    ``documents``: block, place, doc_id, n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2``). ``postings``: block, a, b, plane, n (its popcount), dense, places.
    ``pairs``: a, b, n_documents, n_links, best (the highest count of this A id, ties too).
    """

    documents: DataFrame
    postings: DataFrame
    pairs: DataFrame

    def scores(self) -> DataFrame:
        """``block``, ``place``, ``count_sum``, ``n_best`` of documents that have links."""
        weight = links_of_plane()
        scored = self.postings.join(self.pairs.drop("n_links"), ["a", "b"]).select(
            "block",
            (weight * F.col("n_documents")).alias("count"),
            F.when(F.col("best"), weight).otherwise(F.lit(0)).cast("long").alias("best"),
            "n",
            "dense",
            "places",
        )
        return scored.groupBy("block").applyInArrow(
            _summed, "block long, place int, count_sum long, n_best long"
        )

    def numbers(self) -> DataFrame:
        """Every document's numbers and scores, with the SHA-256 of its groups ('' without)."""
        own = self.documents.select(
            "block",
            "place",
            *("doc_id", "n_a", "n_b", "n_groups", "n_links"),
            F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
        )
        return own.join(self.scores(), ["block", "place"], "left").select(
            *("doc_id", "n_a", "n_b", "n_groups", "n_links"),
            F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
            "groups_sha256",
        )


def links_of_plane():
    """How many links a document in a plane has by it: 1 for plane 0, a binary digit for others."""
    return F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(
        F.expr("shiftleft(1L, plane - 1)")
    )


def _summed(rows: pa.Table) -> pa.Table:
    """Sums per document of one block, whose bitmaps are bounded by the block."""
    rows = rows.combine_chunks()
    block = rows.column("block")[0].as_py()
    count, best, n = (rows.column(name).to_numpy() for name in ("count", "best", "n"))
    dense = np.asarray(rows.column("dense").to_numpy(zero_copy_only=False), bool)
    places = rows.column("places")
    count_sum, n_best = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for row in np.flatnonzero(dense).tolist():
        held = unpacked(places[row].as_py(), True)
        count_sum[held] += count[row]
        n_best[held] += best[row]
    few = np.flatnonzero(~dense)
    for start in range(0, len(few), 50_000):
        part = few[start : start + 50_000]
        held = unpacked(b"".join(places.take(pa.array(part)).to_pylist()), False)
        # Not bincount: its sums are doubles, exact only below 2**53.
        np.add.at(count_sum, held, np.repeat(count[part], n[part]))
        np.add.at(n_best, held, np.repeat(best[part], n[part]))
    filled = np.flatnonzero(count_sum)
    return pa.table(
        {
            "block": pa.array(np.full(len(filled), block, np.int64)),
            "place": pa.array(filled.astype(np.int32)),
            "count_sum": pa.array(count_sum[filled]),
            "n_best": pa.array(n_best[filled]),
        }
    )


def align(docs: DataFrame, a_path: str, b_path: str) -> Alignment:
    """Align the tokens of a byte-level tokenizers file (A) and a sentencepiece model (B)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "alignment")
    rows = documents_of(docs).mapInArrow(released(_read(a_path, b_path)), ROWS)
    rows.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    postings = stored.filter(F.col("a").isNotNull()).select(
        "block", "a", "b", "plane", "n", "dense", "places"
    )
    counted = postings.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_documents"),
        F.sum(F.col("n") * links_of_plane()).alias("n_links"),
    )
    path = scratch_path(spark, "pairs")
    counted.write.parquet(path)
    counted = spark.read.schema(counted.schema).parquet(path)
    highest = counted.groupBy("a").agg(F.max("n_documents").alias("highest"))
    pairs = counted.join(highest, "a").select(
        "a", "b", "n_documents", "n_links", (F.col("n_documents") == F.col("highest")).alias("best")
    )
    documents = stored.filter(F.col("place").isNotNull()).select(
        "block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"
    )
    return Alignment(documents, postings, pairs)
