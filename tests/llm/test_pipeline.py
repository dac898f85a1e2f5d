"""The pipeline stage by stage against plain computations on its own rows."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
import public_tokenizers
from tasktrail.llm.common import written
from tests.llm.samples import no_documents, odd_documents
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import plain

SMALL = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(written(stage(spark, states[-1], SMALL), "stage"))
    for state in states[:-1]:
        assert state.schema == docs.schema
    rows = [{r["doc_id"]: r["text"] for r in state.collect()} for state in states[:-1]]
    texts, good, spoken, single, cut = rows
    told = [doc_id for doc_id in texts if doc_id in labels]
    assert np.mean([(doc_id in good) == bool(labels[doc_id]) for doc_id in told]) > 0.93
    assert not [doc_id for doc_id in told if not labels[doc_id] and doc_id in good]
    assert spoken == good
    roots = plain_components({doc_id: plain_fingerprint(text) for doc_id, text in spoken.items()})
    assert sorted(single) == sorted(set(roots.values()))
    order = sorted(single)
    for doc_id, mask in zip(order, plain([single[doc_id].encode() for doc_id in order])):
        kept = np.frombuffer(single[doc_id].encode(), np.uint8)[~mask].tobytes()
        assert cut[doc_id] == kept.decode("utf-8", "ignore")
    plain_ids = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    packed = states[-1].collect()
    total = sum(len(plain_ids.encode(text, add_special_tokens=False).ids) + 1 for text in cut.values())
    assert sum(row["length"] for row in packed) == total
    assert len({row["sequence_id"] for row in packed}) <= -(-total // 2048) + 1
    ran = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(tuple(r)[:5] for r in ran) == sorted(tuple(r)[:5] for r in packed)


def test_odd_and_no_rows(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        state = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = written(stage(spark, state, SMALL), "stage")
            assert state.schema == docs.schema
        corpus_pipeline.STAGES[-1][1](spark, state, SMALL).collect()


@pytest.mark.parametrize("lang", [None, "en"])
def test_only_texts_without_a_letter_go_for_want_of_a_language(spark, tmp_path, lang):
    # Without labels the quality stage keeps every row.
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([], labels).write.parquet(str(tmp_path / "labels.parquet"))
    texts = [f"some words of document {i}" for i in range(20)] + ["12 34 !?", "", None, "= 5 ="]
    rows = [(i, text, lang, "s", len(text or "")) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    state, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:2]:
        state = written(stage(spark, state, str(tmp_path)), "stage")
        kept.append(sorted(row["doc_id"] for row in state.collect()))
        assert state.schema == docs.schema
    assert kept == [list(range(24)), list(range(20))]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {name.split("_")[0] for name in names if name.startswith("op")} == {f"op{n}" for n in range(1, 14)}
