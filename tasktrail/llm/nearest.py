"""Approximate nearest neighbours by largest inner product, with collision counting.

Vectors that are equal form one candidate, which keeps the few smallest ids it may need.
Candidates are dealt to blocks of bounded size. In a block every vector is extended to
the same length, so that the largest inner product is the smallest distance, and
projected onto random lines; each line keeps its candidates in one sorted array. A query
opens a window around its own projection on every line and widens all windows by a
constant factor (virtual rehashing). A candidate that lies in the windows of half of the
lines has collided often enough; once a share ``VERIFY`` of the block has, these are
verified by their inner product with the original vectors. The width at which this happens
hardly differs between queries, so each looks for its own from that of the queries before.

Queries go to every block, in batches; no pair leaves a block but the best of each query.
Vectors that are null, empty, zero or hold a null or a non-finite component take no part;
vectors of different length are never compared. A repeated row counts once. Ties go to
the smaller id. No row gives an empty result.

Measured recall is in the README; ``LINES`` and ``VERIFY`` trade it against work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tasktrail.llm.common import written

LINES = 128
VERIFY = 0.2
FIRST_WINDOW = 0.4
WIDEN = 1.2
SEED = 11
# A block's vectors and sorted arrays stay in one task's memory.
BLOCK_MOST = 32_768
BLOCK_LEAST = 2_048
QUERIES_AT_A_TIME = 256
# Candidates whose places are compared at a time.
CACHED = 8_192


def level(vectors: np.ndarray) -> np.ndarray:
    """The same proportions with a largest component between 0.5 and 1, by a power of two."""
    _, exponent = np.frexp(np.abs(vectors).max())
    return np.ldexp(vectors, -int(exponent))


class Block:
    """The candidates of one block and one vector length."""

    def __init__(self, vectors: np.ndarray, members: list[list[int]], keep: int):
        self.vectors, self.members, self.keep = vectors, members, keep
        # Distances need no more than proportions, whose squares neither overflow nor vanish.
        vectors = level(vectors)
        self.rough = vectors.astype(np.float32)
        norms = np.sqrt((vectors**2).sum(axis=1))
        self.radius = float(norms.max())
        slack = np.sqrt(np.maximum(self.radius**2 - norms**2, 0))
        lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, LINES))
        self.lines = lines[:-1]
        projected = vectors @ lines[:-1] + slack[:, None] * lines[-1]
        order = np.argsort(projected, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(projected.T, order, axis=1)
        # The place of every candidate on every line: a window is a range of places.
        self.place = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(vectors), dtype=np.uint16)[None], axis=1)
        self.unit = self.radius / np.sqrt(vectors.shape[1])
        # Where the last queries found enough candidates, and room to compare places.
        self.step = 0
        self.offset = np.empty((LINES, min(CACHED, len(vectors))), np.uint16)
        self.inside = np.empty(self.offset.shape, bool)

    def search(self, queries: np.ndarray) -> list[list[tuple[int, float]]]:
        """The best ids and inner products for every query, at most ``keep``."""
        size = len(self.vectors)
        enough = min(size, self.keep + int(VERIFY * size))
        leveled = np.stack([level(query) for query in queries])
        scale = self.radius / np.sqrt((leveled**2).sum(axis=1))
        centre = (leveled * scale[:, None]) @ self.lines
        # No candidate is further than this on any line: the last width holds all of them.
        furthest = np.abs(self.sorted).max() + np.abs(centre).max()
        widths = [FIRST_WINDOW * self.unit * np.sqrt(self.lines.shape[0])]
        while widths[-1] <= furthest:
            widths.append(widths[-1] * WIDEN)
        widths = np.array(widths)
        # Wider windows hold what narrower ones do, so each query looks for its first width
        # with enough candidates from where the queries before it ended.
        step = np.full(len(queries), min(self.step, len(widths) - 1))
        too_few = np.full(len(queries), -1)
        ended = np.full(len(queries), len(widths))
        collided: list[np.ndarray | None] = [None] * len(queries)
        open_ = np.arange(len(queries))
        while len(open_):
            low, high = self._windows(centre[open_], widths[step[open_]])
            for index, query in enumerate(open_.tolist()):
                inside = np.flatnonzero(self._collisions(low[index], high[index]) >= LINES // 2)
                if len(inside) >= enough or step[query] == len(widths) - 1:
                    collided[query], ended[query] = inside, step[query]
                else:
                    too_few[query] = step[query]
            step = np.where(ended < len(widths), ended - 1, too_few + 1)
            open_ = np.flatnonzero(ended - too_few > 1)
        if len(queries):
            self.step = int(np.median(ended))
        return [
            self._verified(query, even, inside)
            for query, even, inside in zip(queries, leveled, collided)
        ]

    def _windows(self, centre: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first place in the window of every query and line, and the first one beyond."""
        return tuple(
            np.stack(
                [row.searchsorted(one, side) for row, one in zip(self.sorted, edge.T)], axis=1
            ).astype(np.uint16)
            for side, edge in (("left", centre - width[:, None]), ("right", centre + width[:, None]))
        )

    def _collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """On how many lines each candidate lies in the window; a part that fits a cache at a time."""
        size = self.place.shape[1]
        count = np.empty(size, np.uint8)
        low, wide = low[:, None], (high - low)[:, None]
        for begin in range(0, size, CACHED):
            part = self.place[:, begin : begin + CACHED]
            # Unsigned: a place below the window wraps round to a large number.
            offset = np.subtract(part, low, out=self.offset[:, : part.shape[1]])
            inside = np.less(offset, wide, out=self.inside[:, : part.shape[1]])
            inside.view(np.uint8).sum(axis=0, dtype=np.uint8, out=count[begin : begin + CACHED])
        return count

    def _verified(
        self, query: np.ndarray, leveled: np.ndarray, candidates: np.ndarray
    ) -> list[tuple[int, float]]:
        if len(candidates) > self.keep:
            # What is near the last kept score stays in, by more than single precision can err.
            scores = self.rough.take(candidates, axis=0) @ leveled.astype(np.float32)
            least = np.partition(scores, -self.keep)[-self.keep]
            room = (len(query) + 8) * 2.0**-22 * self.radius * np.sqrt((leveled**2).sum())
            candidates = candidates[scores >= least - room]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.vectors[candidates] * query).sum(axis=1)
        # Infinite parts of both signs have no sum; they come last.
        scores = np.where(np.isnan(scores), -np.inf, scores)
        pairs = [
            (-score, member)
            for candidate, score in zip(candidates.tolist(), scores.tolist())
            for member in self.members[candidate]
        ]
        return [(member, -score) for score, member in sorted(pairs)[: self.keep]]


def _search(keep: int):
    """Rows come sorted by block, candidates before queries."""

    def best(
        built: dict[int, Block], batch: list[tuple[int, list[float]]]
    ) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, float]] = []
        for length, block in built.items():
            own = [(name, vector) for name, vector in batch if len(vector) == length]
            if own:
                found = block.search(np.array([vector for _, vector in own], np.float64))
                rows += [(name, *pair) for (name, _), pairs in zip(own, found) for pair in pairs]
        if rows:
            names, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())],
                ["class", "vec_id", "score"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting = None, []
        candidates: dict[int, tuple[list, list]] = {}
        built: dict[int, Block] = {}
        for batch in batches:
            for block, is_query, name, vector, members in zip(
                *(column.to_pylist() for column in batch.columns)
            ):
                if block != current:
                    yield from best(built, waiting)
                    current, waiting, candidates, built = block, [], {}, {}
                if not is_query:
                    vectors, ids = candidates.setdefault(len(vector), ([], []))
                    vectors.append(np.array(vector, np.float64))
                    ids.append(members)
                    continue
                if candidates:
                    built = {
                        length: Block(np.stack(vectors), ids, keep)
                        for length, (vectors, ids) in candidates.items()
                    }
                    candidates = {}
                waiting.append((name, vector))
                if len(waiting) == QUERIES_AT_A_TIME:
                    yield from best(built, waiting)
                    waiting = []
        yield from best(built, waiting)

    return run


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part."""
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(
        column,
        lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)),
    )
    return column.isNotNull() & finite & F.exists(column, lambda x: x != 0)


def nearest(embeddings: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` for every query.

    ``embeddings`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")
    ).filter(F.col("vec_id").isNotNull() & usable("vector"))
    rows = rows.withColumn("hash", F.xxhash64("vector"))
    same = ["hash", "vector"]
    # One more than wanted: a query leaves itself out. The limit applies before the shuffle.
    place = F.dense_rank().over(Window.partitionBy(*same).orderBy("vec_id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = first.groupBy(*same).agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    classes = written(classes.withColumn("class", F.col("members")[0]), "vector-classes")
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "hash"])
    asked = written(
        asked.join(classes, same).select(F.col("vec_id").alias("query_id"), "class"), "queries"
    )
    wanted = asked.select("class").distinct()
    size = classes.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-size // BLOCK_MOST), min(tasks, size // BLOCK_LEAST))
    candidates = classes.select(
        F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(False).alias("is_query"),
        "class",
        "vector",
        "members",
    )
    queries = classes.join(wanted, "class", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(True).alias("is_query"),
        "class",
        "vector",
        F.lit(None).cast("array<bigint>").alias("members"),
    )
    dealt = candidates.unionByName(queries).repartitionByRange(blocks, "block")
    found = dealt.sortWithinPartitions("block", "is_query", "class").mapInArrow(
        _search(k + 1), "class long, vec_id long, score double"
    )
    order = [F.desc("score"), F.asc("vec_id")]
    best = F.row_number().over(Window.partitionBy("class").orderBy(*order))
    best = written(
        found.withColumn("place", best).filter(F.col("place") <= k + 1).drop("place"), "nearest"
    )
    others = asked.join(best, "class").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return others.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
