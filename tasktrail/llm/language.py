"""Language identification by multilingual mixture inference.

Training counts letter trigrams of texts with a known language, at most about
``PER_LANGUAGE`` texts of each language, chosen by the hash of their id. A text is then
taken as a mixture: expectation-maximisation estimates the share of each language from
the trigram likelihoods, and the set of languages grows one by one while the gain in
log-likelihood exceeds a penalty. The likelihood is concave in the shares, so the slope
towards a further language bounds its gain, and hopeless ones are not tried.

The prediction is the language with the largest share, the score its share. A text that
is null or has no letter is ``und`` with score 0, as is every text if nothing was
learned. Ties go to the language that sorts first. Repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tasktrail.llm.common import free_name, with_column_of_text

UNDETERMINED = "und"
PER_LANGUAGE = 4000
BUCKETS = 1 << 15
SMOOTHING = 0.5
# Nats per trigram and per language that a further language must gain, besides the usual
# half logarithm: trigrams of one text are not independent.
PENALTY_PER_GRAM = 0.01
MOST_STEPS = 30

_LETTER = regex.compile(r"\p{L}")
# Whatever is ASCII and no letter separates words.
_WORDS = bytes(
    byte if byte >= 0x80 or chr(byte).isalpha() else 0x20 for byte in range(256)
)


def trigrams(text: str) -> np.ndarray:
    """The bucket of every trigram of bytes of the lower-cased words of a text."""
    data = b" ".join(text.lower().encode().translate(_WORDS).split())
    letters = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    code = (letters[:-2] << 16) | (letters[1:-1] << 8) | letters[2:]
    # Multiplicative hashing keeps the upper bits.
    return ((code * np.uint32(2_654_435_761)) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages in order and the probability of each bucket: one row per bucket."""

    languages: tuple[str, ...]
    probability: np.ndarray

    def mixture(self, text: str | None) -> dict[str, float]:
        """The shares of the languages of a text; empty if it has no letter."""
        if text is None or not self.languages or _LETTER.search(text) is None:
            return {}
        grams, counts = np.unique(trigrams(text), return_counts=True)
        likelihood = self.probability[grams].astype(np.float64)
        counts = counts.astype(np.float64)
        total = counts.sum()
        penalty = 0.5 * np.log(total + 1) + PENALTY_PER_GRAM * total
        alone = counts @ np.log(likelihood)
        chosen = [int(np.argmax(alone))]
        share, best = np.ones(1), float(alone[chosen[0]])
        while len(chosen) < len(self.languages):
            mixed = likelihood[:, chosen] @ share
            slope = (counts / mixed) @ likelihood - total
            slope[chosen] = -np.inf
            if slope.max() <= penalty:
                break
            added = int(np.argmax(slope))
            start = np.append(share * 0.9, 0.1)
            grown, value = _expectation_maximisation(likelihood[:, [*chosen, added]], counts, start)
            if value - best <= penalty:
                break
            chosen.append(added)
            share, best = grown, value
        return {self.languages[one]: float(part) for one, part in zip(chosen, share)}

    def predict(self, text: str | None) -> tuple[str, float]:
        shares = self.mixture(text)
        if not shares:
            return UNDETERMINED, 0.0
        language = min(shares, key=lambda one: (-shares[one], one))
        return language, min(1.0, max(0.0, shares[language]))


def _expectation_maximisation(
    likelihood: np.ndarray, counts: np.ndarray, share: np.ndarray
) -> tuple[np.ndarray, float]:
    """Shares that maximise the likelihood of the counts, and its logarithm."""
    total, before = counts.sum(), -np.inf
    for _ in range(MOST_STEPS):
        mixed = likelihood @ share
        value = float(counts @ np.log(mixed))
        share = share * ((counts / mixed) @ likelihood) / total
        if value - before < 1e-6 * abs(value):
            break
        before = value
    return share, float(counts @ np.log(likelihood @ share))


def train(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` where ``usable`` holds and text and lang are known."""
    spark = docs.sparkSession
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").alias("lang"), "text", F.xxhash64(F.col("doc_id"), F.lit(1)).alias("_draw")
    )
    sizes = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model((), np.empty((BUCKETS, 0), np.float32))
    shares = spark.createDataFrame(
        [(lang, min(1.0, per_language / count)) for lang, count in sizes.items()],
        "lang string, _share double",
    )
    draw = F.pmod(F.col("_draw"), F.lit(1 << 20)) < F.col("_share") * (1 << 20)
    sample = known.join(F.broadcast(shares), "lang").filter(draw).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(counts[seen])],
                ["lang", "gram", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, gram int, n long")
    # At most BUCKETS rows per language.
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sizes))
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {lang: index for index, lang in enumerate(languages)}
    counts[table["gram"].to_numpy(int), table["lang"].map(place).to_numpy(int)] += table["n"].to_numpy()
    return Model(languages, (counts / counts.sum(axis=0)).astype(np.float32))


PREDICTION = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
)


def with_language(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """``docs`` with a struct of ``lang_pred`` and ``score``; every other column passes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        learned = sent.value

        def work(texts: list[str | None]) -> list[dict]:
            return [dict(zip(("lang_pred", "score"), learned.predict(text))) for text in texts]

        return work

    return with_column_of_text(docs, name, PREDICTION, start)


def keep_determined(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text has a language; their columns are unchanged.

    A text with a letter always has one. Where no language was learned the letter decides
    alone, so that only null and letterless texts go.
    """
    name = free_name(docs, "language")
    if not model.languages:

        def start():
            return lambda texts: [text is not None and _LETTER.search(text) is not None for text in texts]

        return with_column_of_text(docs, name, T.BooleanType(), start).filter(F.col(name)).drop(name)
    found = with_language(docs, model, name)
    return found.filter(F.col(f"{name}.lang_pred") != UNDETERMINED).drop(name)
