"""Shared helpers: tables written to the folder all executors share, and column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; a
    cluster without it is an error, since no machine-local folder is seen by all.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tasktrail-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(table: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the plan above.
    """
    spark = table.sparkSession
    path = scratch_path(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(target, True)


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and further wanted columns, nothing else."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(folds))


def free_name(table: DataFrame, wanted: str) -> str:
    """``wanted``, or the same with underscores in front if the table has such a column."""
    taken = {name.lower() for name in table.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


# Rows that a Python function works on at a time.
SLICE_ROWS = 1024


def release() -> None:
    """Give what the allocators keep for themselves back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # Another C library: nothing to trim.


def released(work: Callable) -> Callable:
    """A function over Arrow batches that gives memory back to the machine when its task ends.

    Python workers are used again by later tasks; what the allocators keep for themselves
    would stay with the executor until the application ends.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_column_of_text(
    table: DataFrame, name: str, kind: T.DataType, start: Callable[[], Callable], text: str = "text"
) -> DataFrame:
    """Add a column worked out from a text column in Python tasks; all other columns pass.

    ``start`` runs once per task and returns a function from a list of texts, None for
    null, to a list or array of values.
    """
    place = table.columns.index(text)
    schema = T.StructType([*table.schema.fields, T.StructField(name, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in slices(batches):
            values = work(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, arrow)], [*batch.schema.names, name]
            )

    return table.mapInArrow(released(run), schema)
