"""Suffix-array dedup against a count of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasktrail.llm import anchors, suffix_dedup
from tasktrail.llm.queries import op6_suffix_array_dedup
from tasktrail.llm.suffix_order import Suffixes
from tests.conftest import FOLDER
from tests.llm.samples import no_documents, odd_documents, random_texts


def plain(texts, length=200):
    """Covered bytes of each text, as a mask."""
    count = Counter(text[i : i + length] for text in texts for i in range(len(text) - length + 1))
    masks = []
    for text in texts:
        change = np.zeros(len(text) + 1, int)
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        masks.append(np.cumsum(change[:-1]) > 0)
    return masks


def expected(texts):
    for text, mask in zip(texts, plain(texts)):
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        yield len(text), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_query_against_all_strings(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    wanted = dict(zip((r["doc_id"] for r in rows), expected([r["text"].encode() for r in rows])))
    found = op6_suffix_array_dedup(spark, FOLDER).collect()
    assert {row["doc_id"]: tuple(row)[1:] for row in found} == wanted
    assert sum(row["n_removed"] for row in found) > 0


@pytest.mark.parametrize("limit", [20_000, 3])
def test_random_texts(spark, limit):
    texts = random_texts(4, 100) + ["", "é" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {row["doc_id"]: row for row in suffix_dedup.remove_repeats(docs, limit).collect()}
    for number, wanted in enumerate(expected([text.encode() for text in texts])):
        row = found[number]
        removed = sum(span["end"] - span["start"] for span in row["spans"])
        own = (row["n_bytes"], removed, len(row["spans"]), hashlib.sha256(row["kept"]).hexdigest())
        assert own == wanted


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 700)
    texts = [text.encode() for text in random_texts(6, 40)]
    rows = [row for block in anchors.runs(texts) for row in zip(*(c.tolist() for c in block))]
    starts = Counter((number, first + i) for number, _, _, first, count, _ in rows for i in range(count))
    assert set(starts) == {(n, i) for n, text in enumerate(texts) for i in range(len(text) - 199)}
    assert max(starts.values()) == 1


def test_equal_strings_have_equal_anchors():
    texts = [text.encode() for text in random_texts(8, 60)]
    anchor = {}
    for block in anchors.runs(texts):
        for number, gram, _, first, count, distance in zip(*(c.tolist() for c in block)):
            for i in range(count):
                string = texts[number][first + i : first + i + 200]
                assert anchor.setdefault(string, (gram, distance - i)) == (gram, distance - i)


def test_order_of_suffixes():
    rng = np.random.default_rng(0)
    part = rng.integers(97, 99, 400).astype(np.uint8).tobytes()
    data = part + b"x" * 300 + part + rng.integers(97, 123, 300).astype(np.uint8).tobytes()
    places = np.arange(len(data) - 199)
    count = Counter(data[i : i + 200] for i in places)
    found = Suffixes(data, places).repeated(np.zeros(len(places), np.int64))
    assert found.tolist() == [count[data[i : i + 200]] > 1 for i in places]


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffixes_come_in_order_with_common_prefixes(letters):
    rng = np.random.default_rng(letters)
    part = rng.integers(97, 97 + letters, 700).astype(np.uint8)
    near = [part.copy() for _ in range(12)]
    for copy in near:
        copy[rng.integers(0, len(copy), 3)] = rng.integers(0, 256, 3)
    data = b"".join(one.tobytes() for one in near) + b"ab" * 200
    places = rng.permutation(len(data) - 199)
    sets = places % 5
    ordered, common = Suffixes(data, places).order(sets)
    assert sorted(ordered.tolist()) == list(range(len(places)))
    rows = [(int(sets[i]), data[places[i] : places[i] + 200]) for i in ordered.tolist()]
    assert rows == sorted(rows)
    for (last_set, last), (own_set, own), shared in zip(rows, rows[1:], common[1:].tolist()):
        if last_set != own_set:
            assert shared == -1
        else:
            plain = next((i for i in range(200) if last[i] != own[i]), 200)
            assert shared == plain
    assert common[0] == -1


def test_no_suffixes_and_one_suffix():
    for places in (np.zeros(0, np.int64), np.zeros(1, np.int64)):
        suffixes = Suffixes(b"x" * 200, places)
        assert suffixes.order(places)[1].tolist() == [-1] * len(places)
        assert suffixes.repeated(places).tolist() == [False] * len(places)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == 12
    by_id = {row["doc_id"]: row for row in rows}
    assert bytes(by_id[6]["kept"]) == b"" and len(by_id[6]["spans"]) == 1
    assert bytes(by_id[9]["kept"]) == b""
    assert by_id[3]["n_bytes"] == 0 and by_id[4]["spans"] == []
    cut = suffix_dedup.without_repeats(docs)
    assert cut.schema == docs.schema
    cut = {row["doc_id"]: row for row in cut.collect()}
    assert cut[6]["text"] == "" and cut[6]["n_chars"] == 0
    assert cut[3]["text"] is None and cut[1]["text"].startswith("the same")
    assert cut[1]["spans"] == 3


def test_a_cut_character_goes_as_a_whole(spark):
    shared = "é" * 50 + "".join(chr(97 + i % 26) for i in range(400))
    rows = [(1, "日" + shared + "ä"), (2, "本" + shared + "ö")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {row["doc_id"]: row["text"] for row in suffix_dedup.without_repeats(docs).collect()}
    assert kept == {1: "日", 2: "本"} or kept == {1: "日ä", 2: "本ö"}


def test_repeated_rows_keep_their_spans_once(spark):
    passage = " ".join(f"word{i}" for i in range(120))
    rows = [(7, passage + " tail")] * 3000 + [(8, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cut = suffix_dedup.remove_repeats(docs)
    found = cut.select(F.size("spans").alias("spans"), F.length("kept").alias("kept")).distinct()
    assert sorted(map(tuple, found.collect())) == [(1, 0)]
    assert cut.count() == len(rows)


def test_equal_runs_of_a_document_are_one_row(spark):
    line = "".join(chr(97 + i * i % 26) for i in range(260)) + "#"
    texts = [line * 30 + f"tail {i}" for i in range(3)] + [line[:230] + "other", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    keyed = suffix_dedup._keyed(docs)
    found = suffix_dedup.anchor_runs(keyed)
    assert found.count() == found.select("key", "anchor", "run").distinct().count()
    places = found.select(F.explode(suffix_dedup._places()).alias("place"))
    starts = places.agg(F.sum(F.shiftright("place", 8).bitwiseAND(F.lit(255)))).first()[0]
    assert starts == sum(max(0, len(text) - 199) for text in texts)
    for limit in (20_000, 1):
        rows = {row["doc_id"]: row for row in suffix_dedup.remove_repeats(docs, limit).collect()}
        for number, wanted in enumerate(expected([text.encode() for text in texts])):
            row = rows[number]
            removed = sum(span["end"] - span["start"] for span in row["spans"])
            own = (row["n_bytes"], removed, len(row["spans"]), hashlib.sha256(row["kept"]).hexdigest())
            assert own == wanted


def test_no_rows(spark):
    assert suffix_dedup.remove_repeats(no_documents(spark)).collect() == []
    assert suffix_dedup.without_repeats(no_documents(spark)).collect() == []
