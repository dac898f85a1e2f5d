"""Token counts by a digest cache.

Every text is normalised to the bytes that the tokenizer reads and named by their
SHA-256; the tokenizer is named by the SHA-256 of its file. A count that the cache holds
under both digests is joined; only distinct contents that are missing are encoded, and
their counts are appended to the cache.

The tokenizers used here take texts as they are, so normalising means: null is empty.
Any folding of case or white space would change counts. Repeated rows share one cache
entry. A cache that several jobs append to at once may hold an entry twice; readers drop
the copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tasktrail.llm.chunk_tokens import ChunkEncoder
from tasktrail.llm.common import released, scratch_path

CACHE = StructType(
    [
        StructField("tokenizer_digest", StringType()),
        StructField("content_digest", BinaryType()),
        StructField("n_tokens", LongType()),
    ]
)
_ENCODERS: dict[str, ChunkEncoder] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Digest and count of every entry of one tokenizer; an unwritten cache is empty."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return spark.createDataFrame([], CACHE).drop("tokenizer_digest")
    entries = spark.read.schema(CACHE).parquet(path)
    own = entries.filter(F.col("tokenizer_digest") == version)
    return own.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _count(tokenizer_path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
        for batch in batches:
            if batch.num_rows:
                counts = _ENCODERS[tokenizer_path].counts(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"]
                )

    return count


def add_missing(contents: DataFrame, tokenizer_path: str, cache_path: str) -> None:
    """Encode the distinct contents that the cache lacks and append their counts.

    ``contents``: ``content_digest`` and ``text``. Copies meet in a partial aggregate
    before the shuffle, so a content with very many copies costs one row per task.
    """
    spark = contents.sparkSession
    version = tokenizer_digest(tokenizer_path)
    known = read_cache(spark, cache_path, version).select("content_digest")
    distinct = contents.select("content_digest", "text").dropDuplicates(["content_digest"])
    missing = distinct.join(known, "content_digest", "left_anti")
    counted = missing.mapInArrow(released(_count(tokenizer_path)), "content_digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode(
        "append"
    ).parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row.

    ``cache_path`` is a Parquet folder that jobs share; without it the call has a cache
    of its own, which starts empty.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-counts")
    content = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("content_digest"),
        content.alias("text"),
    )
    add_missing(named, tokenizer_path, cache_path)
    counts = read_cache(spark, cache_path, tokenizer_digest(tokenizer_path))
    return named.drop("text").join(counts, "content_digest").drop("content_digest")
