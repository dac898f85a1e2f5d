"""From raw documents to packed training sequences, one operator after the other.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and
its result is written and read again as the next stage's input. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tasktrail.llm import language, quality
from tasktrail.llm.common import fold_of, written
from tasktrail.llm.packing import pack_documents
from tasktrail.llm.simhash import one_of_each
from tasktrail.llm.suffix_dedup import without_repeats


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier scores below one half; it learns as in its own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold_of("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language; the model learns as in its own query."""
    return language.keep_determined(docs, language.train(docs, fold_of("doc_id", 4) != 2))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group."""
    return one_of_each(docs)


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out the passages that occur again."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("SimHash near-dedup", near_duplicate_filter),
    ("suffix-array dedup", repeat_filter),
    ("best-fit packing", packing),
]

# No SQL: fitted models, fingerprints and tokenizers are not expressible there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
