"""Nearest neighbours: recall and exact scores against brute force, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasktrail.llm import nearest as ann
from tasktrail.llm.queries import op5_nearest_neighbours
from tests.conftest import FOLDER


def plain(rows, k, is_query):
    """Ids of the best k by inner product, ties to the smaller id, of (id, vector) rows."""
    ids = np.array([one for one, _ in rows])
    vectors = np.array([vector for _, vector in rows], np.float64)
    for query, vector in zip(ids, vectors):
        if is_query(query):
            scores = (vectors * vector).sum(axis=1)
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:k]
            yield query, [(int(ids[i]), scores[i]) for i in order]


def found_by(frame):
    found = {}
    for row in frame.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(found[row["query_id"]])
    return found


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = found_by(op5_nearest_neighbours(spark, FOLDER))
    shares = []
    for query, best in plain(rows, 20, lambda one: one % 20 == 0):
        own = found.pop(query)
        assert len(own) == 20
        assert own == sorted(own, key=lambda pair: (-pair[1], pair[0]))
        shares.append(len({one for one, _ in best} & {one for one, _ in own}) / 20)
        known = dict(best)
        assert all(score == pytest.approx(known.get(one, score), abs=1e-12) for one, score in own)
    assert not found
    assert np.mean(shares) >= 0.9


def test_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_MOST", 300)
    rng = np.random.default_rng(3)
    rows = [(i, vector.tolist()) for i, vector in enumerate(rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = found_by(ann.nearest(frame, F.col("vec_id") % 20 == 0, 10))
    shares = [
        len({one for one, _ in best} & {one for one, _ in found[query]}) / 10
        for query, best in plain(rows, 10, lambda one: one % 20 == 0)
    ]
    assert np.mean(shares) >= 0.9


def test_copies_ties_and_small_tables(spark):
    same, other = [1.0, 0.0], [0.5, 0.5]
    rows = [(i, same) for i in range(100)] + [(i, other) for i in range(100, 105)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = found_by(ann.nearest(frame, F.col("vec_id") % 20 == 0, 3))
    assert [one for one, _ in found[0]] == [1, 2, 3]
    assert [one for one, _ in found[40]] == [0, 1, 2]
    assert found[100] == [(0, 0.5), (1, 0.5), (2, 0.5)]
    few = spark.createDataFrame(rows[-5:] + [(120, same)], frame.schema)
    found = found_by(ann.nearest(few, F.col("vec_id") % 20 == 0, 20))
    assert [one for one, _ in found[120]] == [100, 101, 102, 103, 104]


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 1.0], 1), (20, None, 1), (40, [], 1), (60, [0.0, 0.0], 1),
        (80, [float("nan"), 1.0], 1), (100, [float("inf"), 1.0], 1), (120, [None, 1.0], 1),
        (None, [1.0, 1.0], 1), (1, [2.0, 1.0], 1), (1, [2.0, 1.0], 1), (2, [-1.0, 0.5], 1),
        (140, [1.0, 2.0, 3.0], 1), (3, [1.0, 0.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class int")
    found = found_by(ann.nearest(frame, F.col("vec_id") % 20 == 0, 20))
    assert found == {0: [(1, 3.0), (2, -0.5)], 140: [(3, 1.0)]}


def test_very_large_and_very_small_components_end():
    for unit in (1e200, 1e-200, 1e300, 5e-324):
        block = ann.Block(np.array([[unit, 0], [0, unit], [unit, unit]]), [[1], [2], [3]], 3)
        assert len(block.search(np.array([[unit, unit], [1.0, 0.0]]))[0]) == 3
    mixed = ann.Block(np.array([[1e200, 0], [0, 1], [1, 1]]), [[1], [2], [3]], 3)
    assert mixed.search(np.array([[1.0, 0.0]]))[0] == [(1, 1e200), (3, 1.0), (2, 0.0)]


def by_widening(block, query, keep):
    """The best members among those that collide at the first width with enough of them."""
    size, even = len(block.vectors), ann.level(query)
    centre = even * (block.radius / np.sqrt((even**2).sum())) @ block.lines
    apart = np.abs(block.sorted[np.arange(ann.LINES)[:, None], block.place] - centre[:, None])
    width = ann.FIRST_WINDOW * block.unit * np.sqrt(len(block.lines))
    while (collided := (apart <= width).sum(axis=0) >= ann.LINES // 2).sum() < keep + int(ann.VERIFY * size):
        width *= ann.WIDEN
    own = np.flatnonzero(collided)
    scores = (block.vectors[own] * query).sum(axis=1)
    best = np.lexsort((own, -scores))[:keep]
    return [(int(own[i]), float(scores[i])) for i in best]


def test_widths_are_found_from_those_of_the_queries_before(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 16)) * rng.uniform(0.2, 3, (900, 1))
    queries = rng.normal(size=(120, 16)) * rng.uniform(1e-3, 1e3, (120, 1))
    monkeypatch.setattr(ann, "CACHED", 400)
    block, looks = ann.Block(vectors, [[i] for i in range(900)], 10), []
    plain = block._collisions
    block._collisions = lambda *window: looks.append(1) or plain(*window)
    wanted = [by_widening(block, query, 10) for query in queries]
    assert block.search(queries) == wanted
    looks.clear()
    assert block.search(queries[::-1]) == wanted[::-1]
    assert len(looks) < 3 * len(queries)


def test_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, F.col("vec_id") % 20 == 0, 20).collect() == []
