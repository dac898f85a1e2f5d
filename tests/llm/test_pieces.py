"""Pieces against the sentencepiece library and the plain merging rule."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tasktrail.llm.pieces import PieceEncoder, encode_decode
from tasktrail.llm.queries import op12_sentencepiece_codec
from tests.llm.samples import no_documents, odd_documents, odd_rows, random_texts

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
ALPHABETS = [
    "ab c", "aeiou tns  ", "▁ a\n", "    \t a", "éüßñ çあ漢字😀 a", "aaa bb",
    "<s></s> <0x41>[]().,;:!?'\"-_=+*/\\ \x00\x01​", "ABCDEFabcdef0123456789 ",
]


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(MODEL)


def own(encoder, text):
    return np.frombuffer(encoder.ids(text), "<i4").tolist()


def test_random_texts_as_the_library_encodes_them(encoder):
    rng = random.Random(5)
    for _ in range(6000):
        letters = rng.choice(ALPHABETS)
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert own(encoder, text) == encoder.library.encode(text), text
    for text in random_texts(3, 60):
        assert own(encoder, text) == encoder.library.encode(text)


def test_parts_equal_plain_merging(encoder):
    rng = random.Random(6)
    for _ in range(2000):
        text = "▁" * rng.randint(0, 20) + "".join(rng.choice("etaoins") for _ in range(12))
        found = [encoder.text[i] for i in encoder.backtracked(text)]
        assert found == encoder.merged(text)


@pytest.mark.parametrize(
    "text", [" " * 400_000 + "a", "a" * 100_000, "\n" * 50_000, "   a" * 50_000, "x" * 17 + " " * 33]
)
def test_long_runs_take_linear_work(encoder, text):
    assert own(encoder, text) == encoder.library.encode(text)


def test_a_full_cache_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr("tasktrail.llm.pieces.CACHE_BYTES", 500)
    for text in random_texts(4, 20):
        assert own(encoder, text) == encoder.library.encode(text)


def test_no_place_is_tried_again_after_it_failed(encoder):
    text = "▁" * 64 + "the"
    calls = []
    plain = encoder.fit
    encoder.fits.clear()
    encoder.fit = lambda before, piece: calls.append(0) or plain(before, piece)
    try:
        encoder.backtracked(text)
    finally:
        del encoder.fit
    assert len(calls) < 16 * len(text)


def test_rows_and_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = odd_documents(spark)
    found = encode_decode(docs, MODEL).collect()
    expected = []
    for row in odd_rows():
        ids = library.encode(row[1] or "", add_eos=True)
        expected.append((row[0], ids, library.decode(ids)))
    key = repr
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert encode_decode(no_documents(spark), MODEL).collect() == []


def test_query_over_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = set()
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(row.text or "", add_eos=True)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        expected.add((row.doc_id, len(ids), digest, decoded))
    assert set(map(tuple, op12_sentencepiece_codec(spark, folder).collect())) == expected
