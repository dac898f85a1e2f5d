"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tasktrail.llm import conversation_repair, language, pieces, quality
from tasktrail.llm.alignment import align
from tasktrail.llm.bpe_codec import encode_decode
from tasktrail.llm.common import fold_of
from tasktrail.llm.merkle import fingerprint_pairs
from tasktrail.llm.nearest import nearest
from tasktrail.llm.packing import pack_documents
from tasktrail.llm.sharding import assign_shards
from tasktrail.llm.simhash import near_duplicates
from tasktrail.llm.suffix_dedup import remove_repeats
from tasktrail.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 512


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_documents(spark, folder)).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(
        _documents(spark, folder), str(public_tokenizers.path("word_bpe_49k.json"))
    )


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    held_out = fold_of("doc_id", 4) == 2
    model = language.train(docs, ~held_out)
    found = language.with_language(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        "language.lang_pred",
        "language.score",
    )


def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_pairs(_documents(spark, folder))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(embeddings, F.col("vec_id") % 20 == 0, 20)


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(_documents(spark, folder))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held_out = fold_of("doc_id", 3) == 1
    model = quality.train(docs, labels, ~held_out)
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(
        _documents(spark, folder), str(public_tokenizers.path("byte_bpe_50k.json"))
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_decode(
        _documents(spark, folder),
        str(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        public_tokenizers.PATTERN,
    )
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = assign_shards(_documents(spark, folder))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = align(
        _documents(spark, folder),
        str(public_tokenizers.path("byte_bpe_50k.json")),
        str(public_tokenizers.path("piece_bpe_32k.model")),
    )
    return aligned.numbers()


def op12_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encode_decode(
        _documents(spark, folder), str(public_tokenizers.path("piece_bpe_32k.model"))
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    repaired = conversation_repair.repair(conversation_repair.damaged(conversations))
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    ordered = repaired.pieces.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("task", "number", "audit", text.alias("text"), F.size("rows").alias("n"))
            )
        ).alias("own")
    )
    whole = ordered.select(
        F.col("conv_id").alias("of"),
        F.array_join("own.audit", "").alias("audit"),
        # Segments of which nothing is left add no line.
        F.array_join(F.filter("own", lambda piece: piece["n"] > 0)["text"], "\n").alias("text"),
    )
    summary = repaired.summary.withColumnRenamed("conv_id", "id")
    same = F.col("conv_id").eqNullSafe
    numbers = [
        F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in conversation_repair.NUMBERS
    ]
    return (
        conversations.select("conv_id")
        .distinct()
        .join(summary, same(F.col("id")), "left")
        .join(whole, same(F.col("of")), "left")
        .select(
            "conv_id",
            *numbers,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"),
        )
    )


def registered() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_language_id": op3_language_id,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_token_counts": op8_token_counts,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_sharding": op10_sharding,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_sentencepiece_codec": op12_sentencepiece_codec,
        "op13_conversation_repair": op13_conversation_repair,
    }


def statements() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {}
