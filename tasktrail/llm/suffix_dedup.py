"""Suffix-array dedup: remove every byte inside a string of 200 bytes that also starts elsewhere.

Equal strings share an anchor (see anchors.py), so only suffixes around anchors that
occur again need to be ordered. Runs of starts with one anchor are rows, equal runs of a
document one row with all their places:

1. Anchors that occur once are settled. If all runs of an anchor have the same bytes, all
   of their strings repeat, and nothing needs sorting; copies meet in a partial aggregate.
2. Of the other anchors every distinct run is fetched once, and the suffixes of all runs
   of an anchor are ordered by deep-shallow sorting (see suffix_order.py), set by set of
   those that can be equal. Neighbours that share 200 bytes are repeated.
3. Repeated starts go back to all documents that have the run, one row of stretches per
   run, and the bytes they cover are cut out.

An anchor with more than ``RUNS_PER_TASK`` distinct runs would be too much for one task.
Its strings are dealt by their own hash instead and counted by a partial aggregate.

Runs are compared by two 64-bit hashes, rows are named by a 64-bit hash of id and text.
Texts travel compressed. Null texts count as empty, texts below 200 bytes stay whole.
Matches never reach over the end of a text. Repeated rows are documents of their own, so
their texts repeat. Order and further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tasktrail.llm.anchors import LENGTH, Hashes, runs
from tasktrail.llm.common import (
    documents_of,
    free_name,
    released,
    remove,
    slices,
    with_column_of_text,
    written,
)
from tasktrail.llm.suffix_order import Suffixes

RUNS_PER_TASK = 20_000
# Bytes of strings that are sorted at a time, but at least one whole anchor.
SORT_BYTES = 3 << 20
BATCH_BYTES = 4 << 20
PACK_LEVEL = 1

_RUN = "anchor long, run long, key long, place long, more array<long>"
_STRING = "anchor long, run long, copies long, first int, string binary"
_FOUND = "anchor long, run long, stretches array<struct<low:int,high:int>>"
# A place holds first start, number of starts and distance to the anchor in one integer.
_FIELD = 8


def _key() -> Column:
    """The name of a row."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """``key`` beside ``doc_id`` and ``text``."""
    return documents_of(docs).withColumn("key", _key())


def _packed(keyed: DataFrame) -> DataFrame:
    """The rows with their texts compressed for the shuffle."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        packer = ZstdCompressor(level=PACK_LEVEL)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([packer.compress(one.as_py()) for one in texts], pa.binary()),
                ],
                ["key", "doc_id", "packed"],
            )

    return keyed.select("key", "doc_id", "text").mapInArrow(
        pack, "key long, doc_id long, packed binary"
    )


def _unpack(packed: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(packed)


def anchor_runs(keyed: DataFrame) -> DataFrame:
    """One row per run of starts that share an anchor, with all its places in a document.

    The first is ``place``; where the document (in one block) has others, ``more`` lists them.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = batch.column(0).to_numpy()
            texts = [one.as_py() for one in batch.column(1).cast(pa.binary())]
            for number, anchor, run, first, count, distance in runs(texts):
                place = (first << 2 * _FIELD) | (count << _FIELD) | distance
                by = np.lexsort((first, run, anchor, number))
                number, anchor, run, place = number[by], anchor[by], run[by], place[by]
                new = np.ones(len(by), bool)
                new[1:] = (number[1:] != number[:-1]) | (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])
                own = np.flatnonzero(new)
                others = np.diff(np.append(own, len(by))) - 1
                more = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(others)]).astype(np.int32),
                    pa.array(place[~new]),
                    mask=pa.array(others == 0),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[own]),
                        pa.array(run[own]),
                        pa.array(keys[number[own]]),
                        pa.array(place[own]),
                        more,
                    ],
                    ["anchor", "run", "key", "place", "more"],
                )

    return keyed.select("key", "text").mapInArrow(released(find), _RUN)


def _copies() -> Column:
    """How many places a row has."""
    return 1 + F.coalesce(F.array_size("more"), F.lit(0))


def _places() -> Column:
    return F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<long>")))


def _span(place: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """The bytes that the starts of a run at ``place`` cover, or some of them."""
    first = F.shiftright(place, 2 * _FIELD)
    low = F.lit(0) if low is None else low
    high = F.shiftright(place, _FIELD).bitwiseAND(F.lit((1 << _FIELD) - 1)) if high is None else high
    return F.struct((first + low).alias("start"), (first + high + (LENGTH - 1)).alias("end"))


def _strings(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted runs (anchor, run, copies, key, place), each from one document."""
    of_document = wanted.groupBy("key").agg(
        F.collect_list(F.struct("anchor", "run", "copies", "place")).alias("wanted")
    )

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for one, asked in zip(batch.column(0), batch.column(1).to_pylist()):
                text = _unpack(one.as_py())
                for run in asked:
                    place = run["place"]
                    first, count = place >> 2 * _FIELD, (place >> _FIELD) & 0xFF
                    string = text[first : first + count + LENGTH - 1]
                    rows.append((run["anchor"], run["run"], run["copies"], place & 0xFF, string))
                    held += len(string)
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return (
        packed.join(of_document, "key")
        .select("packed", "wanted")
        .mapInArrow(released(fetch), _STRING)
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
        ["anchor", "run", "copies", "first", "string"],
    )


def _stretches(repeated: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal stretches of repeated starts that stay within one run: run, low, high."""
    number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    place = np.flatnonzero(repeated)
    if not len(place):
        return place, place, place
    new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(number[place]) != 0)])
    begin = np.flatnonzero(new)
    low = place[begin]
    high = place[np.append(begin[1:], len(place)) - 1] + 1
    own = number[low]
    return own, low - edges[own], high - edges[own]


def _order(
    anchors: np.ndarray, names: np.ndarray, copies: np.ndarray, distance: np.ndarray, strings: list[bytes]
) -> pa.RecordBatch:
    """The repeated starts of whole anchors."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = sizes - (LENGTH - 1)
    edges = np.concatenate([[0], np.cumsum(counts)])
    number = np.repeat(np.arange(len(strings)), counts)
    inside = np.arange(edges[-1]) - edges[number]
    begins = np.cumsum(sizes) - sizes
    _, group = np.unique(anchors, return_inverse=True)
    sets = group[number] * (LENGTH + 1) + distance[number] - inside
    repeated = Suffixes(b"".join(strings), begins[number] + inside).repeated(sets)
    repeated |= (copies > 1)[number]
    own, low, high = _stretches(repeated, edges)
    return _found(anchors, names, own, low, high)


def _found(
    anchors: np.ndarray, names: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray
) -> pa.RecordBatch:
    """One row per run that has a stretch; ``own`` says whose each is, in ascending order."""
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    stretches = pa.StructArray.from_arrays(
        [pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["low", "high"]
    )
    edges = np.append(begin, len(own)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchors[own[begin]]),
            pa.array(names[own[begin]]),
            pa.ListArray.from_arrays(edges, stretches),
        ],
        ["anchor", "run", "stretches"],
    )


def _sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and run; anchors are kept whole."""
    held: list[pa.RecordBatch] = []
    size = 0

    def worked(table: pa.Table) -> pa.RecordBatch:
        anchors, names = table.column(0).to_numpy(), table.column(1).to_numpy()
        # A repeated row of the input fetches its runs twice.
        own = np.ones(len(anchors), bool)
        own[1:] = (anchors[1:] != anchors[:-1]) | (names[1:] != names[:-1])
        strings = [one for one, kept in zip(table.column(4).to_pylist(), own) if kept]
        return _order(
            anchors[own], names[own], table.column(2).to_numpy()[own],
            table.column(3).to_numpy()[own].astype(np.int64), strings,
        )

    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            part = batch.slice(begin, 4096)
            held.append(part)
            size += part.nbytes
            if size < SORT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchors = table.column(0).to_numpy()
            changes = np.flatnonzero(anchors[1:] != anchors[:-1])
            if len(changes):
                whole = int(changes[-1]) + 1
                yield worked(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(one.nbytes for one in held)
    if held:
        yield worked(pa.Table.from_batches(held))


def _dealt(strings: DataFrame) -> DataFrame:
    """The repeated starts of anchors with very many runs, by a hash of every string."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, run, copies, _, string in zip(*(one.to_pylist() for one in batch.columns)):
                found = Hashes(np.frombuffer(string, np.uint8)).grams(LENGTH).view(np.int64)
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([anchor] * size, pa.int64()),
                        pa.array([run] * size, pa.int64()),
                        pa.array([copies] * size, pa.int64()),
                        pa.array(np.arange(size, dtype=np.int32)),
                        pa.array(found),
                    ],
                    ["anchor", "run", "copies", "low", "string"],
                )

    dealt = strings.dropDuplicates(["anchor", "run"]).mapInArrow(
        deal, "anchor long, run long, copies long, low int, string long"
    )
    dealt = written(dealt, "dealt-strings")
    counted = dealt.groupBy("anchor", "string").agg(F.sum("copies").alias("_all"))
    several = written(counted.filter(F.col("_all") > 1).drop("_all"), "dealt-repeats")
    # A run has less than LENGTH starts.
    repeated = dealt.join(several, ["anchor", "string"], "left_semi")
    lows = repeated.groupBy("anchor", "run").agg(F.collect_list("low").alias("lows"))

    def stretch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, names, lists = batch.columns
            counts = lists.value_lengths().to_numpy()
            mask = np.zeros(LENGTH * len(counts), bool)
            mask[np.repeat(np.arange(len(counts)) * LENGTH, counts) + lists.flatten().to_numpy()] = True
            found = _stretches(mask, np.arange(len(counts) + 1) * LENGTH)
            yield _found(anchors.to_numpy(), names.to_numpy(), *found)

    return lows.mapInArrow(stretch, _FOUND)


def repeated_spans(keyed: DataFrame, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """``key`` and ``spans``, the bytes [start, end) to remove, unsorted and overlapping."""
    found = written(anchor_runs(keyed), "anchor-runs")
    by_anchor = found.groupBy("anchor").agg(
        F.sum(_copies()).alias("n"), F.min("run").alias("low"), F.max("run").alias("high")
    )
    again = written(
        by_anchor.filter(F.col("n") > 1).select("anchor", (F.col("low") == F.col("high")).alias("alike")),
        "repeated-anchors",
    )
    shared = written(found.join(again, "anchor"), "shared-runs")
    remove(found)
    alike = shared.filter("alike").select("key", F.transform(_places(), lambda place: _span(place)).alias("spans"))
    mixed = shared.filter(~F.col("alike"))
    distinct = written(
        mixed.groupBy("anchor", "run")
        .agg(F.sum(_copies()).alias("copies"), F.min(F.struct("key", "place")).alias("one"))
        .select("anchor", "run", "copies", "one.key", "one.place"),
        "distinct-runs",
    )
    crowded = written(
        distinct.groupBy("anchor").count().filter(F.col("count") > runs_per_task).select("anchor"),
        "crowded-anchors",
    )
    some = not crowded.isEmpty()
    sortable = distinct.join(crowded, "anchor", "left_anti") if some else distinct
    strings = _strings(_packed(keyed), sortable)
    ordered = strings.repartition("anchor").sortWithinPartitions("anchor", "run")
    repeated = ordered.mapInArrow(released(_sort), _FOUND)
    if some:
        crowd = distinct.join(crowded, "anchor", "left_semi")
        repeated = repeated.unionByName(_dealt(_strings(_packed(keyed), crowd)))
    repeated = written(repeated, "repeated-starts")
    spans = F.flatten(
        F.transform(
            _places(),
            lambda place: F.transform("stretches", lambda one: _span(place, one["low"], one["high"])),
        )
    )
    sorted_out = mixed.join(repeated, ["anchor", "run"]).select("key", spans.alias("spans"))
    return (
        alike.unionByName(sorted_out)
        .groupBy("key")
        # Equal rows have one key and equal spans, which are kept once.
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint spans that cover the same bytes; touching ones become one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _own_spans(listed: pa.Scalar) -> list[list[int]]:
    if not listed.is_valid:
        return []
    return merged(np.stack([one.to_numpy() for one in listed.values.flatten()], axis=1)).tolist()


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(edge for span in spans for edge in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (sorted array of start and end) and the bytes ``kept``."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, runs_per_task)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            lists = batch.column(2)
            for index, (doc_id, packed) in enumerate(zip(batch.column(0), batch.column(1))):
                text = _unpack(packed.as_py())
                own = _own_spans(lists[index])
                kept = _without(text, own)
                rows.append(
                    (doc_id.as_py(), len(text), [{"start": a, "end": b} for a, b in own], kept)
                )
                held += len(text)
                if held > BATCH_BYTES:
                    yield _kept(rows)
                    rows, held = [], 0
            if rows:
                yield _kept(rows)

    return (
        _packed(keyed)
        .join(spans, "key", "left")
        .select("doc_id", "packed", "spans")
        .mapInArrow(
            cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
        )
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, size, spans, kept = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_id, pa.int64()),
            pa.array(size, pa.int64()),
            pa.array(spans, _SPANS),
            pa.array(kept, pa.binary()),
        ],
        ["doc_id", "n_bytes", "spans", "kept"],
    )


def without_repeats(docs: DataFrame, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """``docs`` with shortened texts and, if there is that column, their new ``n_chars``.

    Spans are bytes; a character of which a part goes, goes as a whole. A null text stays
    null. All rows and other columns stay.
    """
    key, packed, spans = (free_name(docs, name) for name in ("key", "packed", "spans"))

    def start():
        from zstandard import ZstdCompressor

        packer = ZstdCompressor(level=PACK_LEVEL)
        return lambda texts: [
            None if text is None else packer.compress(text.encode()) for text in texts
        ]

    found = repeated_spans(_keyed(docs), runs_per_task)
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans))
    named = with_column_of_text(docs.withColumn(key, _key()), packed, T.BinaryType(), start)
    joined = named.drop("text").join(found, key, "left").drop(key)
    names = joined.columns
    kinds = {field.name: to_arrow_type(field.dataType) for field in docs.schema}

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(names.index(spans))
            texts = [
                _without(_unpack(one.as_py()), _own_spans(lists[index])).decode("utf-8", "ignore")
                if one.is_valid
                else None
                for index, one in enumerate(batch.column(names.index(packed)))
            ]
            columns = []
            for name, kind in kinds.items():
                if name == "text":
                    columns.append(pa.array(texts, kind))
                elif name == "n_chars":
                    columns.append(pa.array([len(text or "") for text in texts], kind))
                else:
                    columns.append(batch.column(names.index(name)))
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    return joined.mapInArrow(released(cut), docs.schema)
