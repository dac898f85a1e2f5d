"""Where alerts are written: one folder per output and batch."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tasktrail.sources.schemas import MESSAGES, TABLES, USER_MESSAGES

if TYPE_CHECKING:
    from tasktrail.plans.alerts import Alerts


def write_alerts(alerts: Alerts, folder: str, batch: int | str) -> None:
    """Append the outputs of one batch of changes; the same batch again replaces itself.

    The stored rows come last: a batch whose rows are stored has all its messages.
    """
    write_batch(alerts.messages, folder, "messages", batch)
    write_batch(alerts.user_messages, folder, "user_messages", batch)
    write_batch(alerts.stored, folder, "stored", batch)


def write_batch(rows: DataFrame, folder: str, output: str, batch: int | str) -> str:
    """Write one output of a batch, in place of an earlier try; its folder."""
    path = f"{folder.rstrip('/')}/{output}/batch={batch}"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _read(spark: SparkSession, folder: str, output: str, schema: StructType) -> DataFrame:
    batches = spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{output}")
    return batches.select(*schema.names)


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "messages", MESSAGES)


def read_user_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "user_messages", USER_MESSAGES)


def read_stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows as stored, flags taken back; ``table`` names their schema."""
    return _read(spark, folder, "stored", TABLES[table])
