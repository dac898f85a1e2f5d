"""Language ID and quality: held-out accuracy, folds and odd rows."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasktrail.llm import language, quality
from tasktrail.llm.queries import op3_language_id, op7_quality_classifier
from tests.llm.samples import no_documents, odd_documents

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_language_of_held_out_documents(spark, docs):
    known = dict(docs.select("doc_id", "lang").collect())
    rows = op3_language_id(spark, SMALL).collect()
    assert len(rows) == len(known)
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
    held = [row for row in rows if row["held_out"]]
    assert np.mean([row["lang_pred"] == known[row["doc_id"]] for row in held]) > 0.97


def test_language_learns_nothing_from_held_out_rows(spark, docs):
    usable = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    changed = docs.withColumn("lang", F.when(usable, F.col("lang")).otherwise(F.lit("xx")))
    one, two = language.train(docs, usable), language.train(changed, usable)
    assert one.languages == two.languages
    assert np.array_equal(one.probability, two.probability)


def test_mixture_shares(spark, docs):
    model = language.train(docs, F.lit(True))
    texts = {
        lang: " ".join(r["text"] for r in docs.filter(F.col("lang") == lang).limit(6).collect())
        for lang in ("en", "de")
    }
    half = texts["en"][:3000] + " " + texts["de"][:3000]
    shares = model.mixture(half)
    assert set(shares) == {"en", "de"}
    assert 0.35 < shares["en"] < 0.65
    assert sum(shares.values()) == pytest.approx(1)
    assert set(model.mixture(texts["en"][:3000])) == {"en"}


def test_expectation_maximisation_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    likelihood = rng.dirichlet(np.ones(50), 3).T
    counts = rng.multinomial(500, likelihood @ np.array([0.7, 0.3, 0.0])).astype(float)
    start = np.full(3, 1 / 3)
    before = counts @ np.log(likelihood @ start)
    share, value = language._expectation_maximisation(likelihood, counts, start)
    assert value >= before and share.sum() == pytest.approx(1)
    assert share[0] == pytest.approx(0.7, abs=0.15)


def test_language_of_odd_rows(spark, docs):
    model = language.train(docs, F.lit(True))
    found = language.with_language(odd_documents(spark), model, "found")
    assert found.columns == [*odd_documents(spark).columns, "found"]
    rows = {row["doc_id"]: row["found"] for row in found.collect()}
    assert [rows[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3
    assert rows[3]["score"] == 0 and rows[6]["lang_pred"] in model.languages
    assert model.predict("12 34 !?") == ("und", 0.0)
    assert model.predict("a")[0] in model.languages
    kept = language.keep_determined(odd_documents(spark), model)
    assert kept.columns == odd_documents(spark).columns
    assert kept.count() == 8
    nothing = language.train(no_documents(spark), F.lit(True))
    assert nothing.predict("some words") == ("und", 0.0)
    assert language.with_language(no_documents(spark), model).collect() == []


def test_quality_of_held_out_documents(spark):
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect())
    rows = op7_quality_classifier(spark, SMALL).collect()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
    held = [row for row in rows if row["held_out"] and row["doc_id"] in labels]
    assert np.mean([row["predicted"] == labels[row["doc_id"]] for row in held]) > 0.92
    good = [row["score"] for row in held if labels[row["doc_id"]]]
    bad = [row["score"] for row in held if not labels[row["doc_id"]]]
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_quality_learns_no_label_of_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    usable = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    changed = labels.withColumn(
        "quality", F.when(usable, F.col("quality")).otherwise(1 - F.col("quality"))
    )
    one, two = quality.train(docs, labels, usable), quality.train(docs, changed, usable)
    assert np.array_equal(one.weight, two.weight) and one.prior == two.prior


def test_the_risk_separates_positives_from_the_rest_of_the_unlabelled():
    rng = np.random.default_rng(2)
    width = quality.BUCKETS + quality.STATISTICS
    good, bad = rng.normal(1, 1, (600, width)), rng.normal(-1, 1, (400, width))
    model = quality.fit(good[:200], np.concatenate([good[200:], bad]), 0.5)

    def score(rows):
        return ((rows - model.mean) / model.scale) @ model.weight[:-1] + model.weight[-1]

    assert (score(good) > 0).mean() > 0.95 and (score(bad) < 0).mean() > 0.95


def test_a_share_of_any_table_is_drawn(spark):
    rows = spark.range(40_000).withColumnRenamed("id", "doc_id")
    assert 300 < quality._draw(rows, 400, 40_000, 3).count() < 500
    assert quality._draw(rows, 400, 300, 3).count() == 40_000
    # As if the table had 5e11 rows: the bound is far below 2**-20 of them, but not nothing.
    plan = quality._draw(rows, 10_000, 5 * 10**11, 3)
    bound = 10_000 * 2**64 // (5 * 10**11) - 2**63
    assert bound > -(2**63) and plan.count() <= 5


def test_quality_of_odd_rows(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels, F.lit(True))
    rows = quality.with_score(odd_documents(spark), model, "found").collect()
    assert len(rows) == 12 and all(0 <= row["found"] <= 1 for row in rows)
    scores = {row["doc_id"]: row["found"] for row in rows}
    assert scores[3] == scores[4]
    assert quality.keep_good(odd_documents(spark), model).columns == odd_documents(spark).columns
    assert quality.with_score(no_documents(spark), model).collect() == []
    untold = quality.train(docs, labels.filter("quality = 0"), F.lit(True))
    assert untold.score(["any text", None]).tolist() == [0.5, 0.5]
    twice = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    assert quality.train(docs, twice, F.lit(True)).score(["any text"]).tolist() == [0.5]
    nothing = quality.train(no_documents(spark), labels, F.lit(True))
    assert nothing.score(["any text"]).tolist() == [0.5]


def test_the_fit_makes_no_copy_of_its_rows():
    rng = np.random.default_rng(3)
    width = quality.BUCKETS + quality.STATISTICS
    positive, unlabelled = (rng.random((n, width)).astype(np.float32) for n in (1500, 3000))
    tracemalloc.start()
    try:
        model = quality.fit(positive, unlabelled, 0.3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # A few batches in doubles, whatever the number of rows.
    assert peak < 40 << 20
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    assert np.allclose(model.mean, both.mean(axis=0), rtol=0, atol=1e-12)
    assert np.allclose(model.scale, both.std(axis=0) + 1e-3, rtol=0, atol=1e-12)
