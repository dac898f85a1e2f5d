"""Shards against a plain minimax search."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasktrail.llm import sharding
from tasktrail.llm.queries import op10_sharding
from tests.conftest import FOLDER
from tests.llm.samples import no_documents, odd_documents


def smallest_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle, number, held = (low + high) // 2, 1, 0
        for size in sizes:
            if held + size > middle:
                number, held = number + 1, 0
            held += size
        low, high = (low, middle) if number <= shards else (middle + 1, high)
    return low


def check(rows, shards):
    held, texts = {}, {}
    for row in rows:
        held.setdefault(row["shard"], []).append(row["slot"])
        assert 0 <= row["shard"] < shards
    for slots in held.values():
        assert sorted(slots) == list(range(len(slots)))


def test_query(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    rows = op10_sharding(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    check(rows, 40)
    shard_of = {}
    for row in rows:
        data = texts[row["doc_id"]].encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert (row["law"], row["grown_shard"]) == ("bytes", None)
        assert shard_of.setdefault(data, row["shard"]) == row["shard"]


@pytest.mark.parametrize("seed,bits,shards", [(0, 4, 7), (1, 16, 7), (2, 8, 3), (3, 1, 12), (4, 6, 1)])
def test_the_capacity_is_the_smallest(spark, monkeypatch, seed, bits, shards):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 400))
    # Some groups lie close together, so that only the last bits tell them apart.
    keys = np.unique(np.concatenate([keys, keys[:20] + 1, keys[:20] + 2]))
    sizes = rng.integers(16, 2000, len(keys))
    table = spark.createDataFrame(
        [(int(key), int(part)) for key, size in zip(keys, sizes) for part in (size // 2, size - size // 2)],
        "_key long, size long",
    )
    found = sharding.Ranges.of(sharding._totals(table, bits).collect(), bits)
    capacity, cuts = sharding.minimax_cuts(table, found, shards)
    assert capacity == smallest_capacity(sizes.tolist(), shards)
    edges = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    assert len(cuts) < shards
    assert max(sizes[a:b].sum() for a, b in zip(edges, edges[1:])) == capacity


def test_a_giant_group_leaves_the_others_even(spark):
    rng = random.Random(1)
    texts = ["the giant" * 20] * 400 + ["x" * rng.randint(50, 100) + str(i) for i in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.assign_shards(docs, 10).collect()
    check(rows, 10)
    assert len({row["shard"] for row in rows if row["doc_id"] < 400}) == 1
    held = {}
    for row in rows:
        held[row["shard"]] = held.get(row["shard"], 0) + row["size"]
    rest = sorted(held.values())[:-1]
    assert len(held) == 10 and max(rest) < 1.1 * min(rest)


def test_a_hot_range_is_numbered_in_lanes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_LANE", 20)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    check(sharding.assign_shards(docs, 4).collect(), 4)


def test_odd_rows(spark):
    rows = sharding.assign_shards(odd_documents(spark), 5).collect()
    assert len(rows) == 12
    check(rows, 5)
    empty = [row for row in rows if row["size"] == 16]
    assert len(empty) == 3 and len({row["shard"] for row in empty}) == 1
    assert {row["text_crc32"] for row in empty} == {0}


def test_no_rows(spark):
    assert sharding.assign_shards(no_documents(spark)).collect() == []
