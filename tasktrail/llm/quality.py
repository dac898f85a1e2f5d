"""A quality classifier learned from positives and unlabelled text.

A linear score over features of a text minimises the non-negative unbiased risk of
positive-unlabelled learning (Kiryo and others, 2017): with class prior p,

    p E_pos[loss(g, +)] + max(0, E_unl[loss(g, -)] - p E_pos[loss(g, -)])

over trusted positives and unlabelled texts. Where the second term turns negative, its
gradient is followed the other way, which stops the fit from explaining all unlabelled
text away. The prior is estimated by the share of positives among the labelled rows that
may be learned from.

Training draws at most about ``POSITIVES`` and ``UNLABELLED`` texts by the hash of their
id; scoring reads every whole text. An id with several labels is positive only if all of
them are. Null texts score like empty ones. Without any positive to learn from every
score is one half. Repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tasktrail.llm.common import free_name, release, with_column_of_text

POSITIVES = 5000
UNLABELLED = 10_000
BUCKETS = 512
STEPS = 400
BATCH = 1024
RATE = 0.02
# Weight decay at POSITIVES texts; smaller samples are held tighter.
DECAY = 1e-2
SEED = 7
LEAST_PRIOR, MOST_PRIOR = 0.02, 0.98

# Classes of bytes: lower case, upper case, digit, beyond ASCII, space; others as they are.
_CLASS = bytes(
    ord("a") if 0x61 <= byte <= 0x7A
    else ord("A") if 0x41 <= byte <= 0x5A
    else ord("0") if 0x30 <= byte <= 0x39
    else ord("b") if byte >= 0x80
    else ord(" ") if byte in (0x09, 0x0D) else byte
    for byte in range(256)
)
STATISTICS = 14


def features(text: str | None) -> np.ndarray:
    """Shares of hashed four-grams of byte classes, and statistics of words and lines."""
    found = np.zeros(BUCKETS + STATISTICS, np.float32)
    data = (text or "").encode()
    if not data:
        return found
    shape = np.frombuffer(b"\n" + data.translate(_CLASS) + b"\n\n", np.uint8)
    codes = shape.astype(np.uint32)
    codes = (codes[:-3] << 24) | (codes[1:-2] << 16) | (codes[2:-1] << 8) | codes[3:]
    buckets = ((codes * np.uint32(2_654_435_761)) >> np.uint32(23)).astype(np.int64)
    found[:BUCKETS] = np.sqrt(np.bincount(buckets, minlength=BUCKETS) / len(buckets))
    size = len(data)
    counts = np.bincount(shape, minlength=256)
    letters = counts[ord("a")] + counts[ord("A")] + counts[ord("b")]
    words, lines = data.split(), [line for line in data.split(b"\n") if line]
    distinct, distinct_lines = len(set(words)), len(set(lines))
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.float32, len(words)) if words else np.zeros(1)
    spaces = counts[ord(" ")] + counts[ord("\n")]
    found[BUCKETS:] = (
        1.0,
        np.log1p(size) / 10,
        counts[ord("A")] / max(1, letters),
        counts[ord("0")] / size,
        counts[ord("b")] / size,
        max(0, size - letters - counts[ord("0")] - spaces) / size,
        spaces / size,
        lengths.mean() / 10,
        min(lengths.std() / 10, 3.0),
        distinct / n_words,
        np.log1p(distinct) / np.log1p(n_words),
        distinct_lines / n_lines,
        np.log1p(n_words / n_lines) / 5,
        min(float(lengths.max()) / 100, 3.0),
    )
    return found


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        rows = np.stack([features(text) for text in texts])
        margin = ((rows - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _spread(sets: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each column over all rows, in doubles, a batch of rows at a time."""
    count = sum(map(len, sets))

    def total(of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        held = np.zeros(sets[0].shape[1])
        for rows in sets:
            for start in range(0, len(rows), BATCH):
                part = of(rows[start : start + BATCH].astype(np.float64))
                held = np.concatenate([held[None], part]).sum(axis=0)
        return held

    mean = total(lambda rows: rows) / count
    return mean, np.sqrt(total(lambda rows: (rows - mean) ** 2) / count) + 1e-3


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk with the sigmoid loss by stochastic steps."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), prior)
    mean, scale = _spread((positive, unlabelled))
    weight = np.zeros(width + 1)

    def drawn(rows: np.ndarray) -> np.ndarray:
        own = rows[rng.integers(0, len(rows), BATCH)]
        return np.concatenate([(own - mean) / scale, np.ones((len(own), 1))], axis=1)

    rng = np.random.default_rng(SEED)
    decay = DECAY * max(1.0, POSITIVES / len(positive)) ** 0.5
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    average = np.zeros_like(weight)
    for step in range(1, STEPS + 1):
        pos, unl = drawn(positive), drawn(unlabelled)
        # sigmoid(-z) is the loss of a positive with margin z, sigmoid(z) that of a negative.
        p = 1 / (1 + np.exp(-np.clip(pos @ weight, -30, 30)))
        u = 1 / (1 + np.exp(-np.clip(unl @ weight, -30, 30)))
        slope_pos = (p * (1 - p)) @ pos / BATCH
        slope_unl = (u * (1 - u)) @ unl / BATCH
        negative_risk = u.mean() - prior * p.mean()
        slope_negative = slope_unl - prior * slope_pos
        slope = -slope_negative if negative_risk < 0 else slope_negative - prior * slope_pos
        slope = slope + decay * weight
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        step_size = RATE / (1 + step / 200)
        weight = weight - step_size * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
        if step > STEPS // 2:
            average += weight / (STEPS - STEPS // 2)
    return Model(mean, scale, average, prior)


def _draw(rows: DataFrame, wanted: int, count: int, salt: int) -> DataFrame:
    """About ``wanted`` of ``count`` rows, by the hash of their id."""
    if count <= wanted:
        return rows
    # All 64 bits of the hash, so that a share of any table is not rounded to nothing.
    bound = wanted * 2**64 // count - 2**63
    return rows.filter(F.xxhash64(F.col("doc_id").cast("long"), F.lit(salt)) < F.lit(bound))


def _rows(texts: DataFrame) -> np.ndarray:
    """The features of a bounded set of texts, on the driver."""

    def start():
        return lambda batch: [features(text).tobytes() for text in batch]

    found = with_column_of_text(texts.select("text"), "features", T.BinaryType(), start)
    rows = [bytes(row["features"]) for row in found.select("features").collect()]
    # A fixed order, because training draws by place.
    rows.sort()
    flat = np.frombuffer(b"".join(rows), np.float32)
    return flat.reshape(len(rows), BUCKETS + STATISTICS)


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Learn from the documents and labels (``doc_id``, ``quality``) where ``usable`` holds.

    ``usable`` is a condition on ``doc_id``.
    """
    told = (
        labels.filter(usable & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
    )
    tally = told.agg(
        F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("good")
    ).first()
    good = tally["good"] or 0
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, good / max(1, tally["n"])))
    # About POSITIVES ids, so the broadcast is bounded.
    ids = _draw(told.filter(F.col("quality") == 1), POSITIVES, good, 2).select("doc_id")
    texts = docs.filter(usable).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    positive = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    rows = texts.select("doc_id").count()
    known, drawn = _rows(positive), _rows(_draw(texts, UNLABELLED, rows, 3))
    if rows and good and not len(drawn):
        raise ValueError(f"none of {rows} texts was drawn to learn from")
    release()
    return fit(known, drawn, prior)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of every row; every other column passes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        return sent.value.score

    return with_column_of_text(docs, name, T.DoubleType(), start)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows that score at least ``least``; their columns are unchanged."""
    name = free_name(docs, "quality_score")
    return with_score(docs, model, name).filter(F.col(name) >= least).drop(name)
