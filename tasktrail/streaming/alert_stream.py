"""Alerts from a stream of row versions.

Each version is one inserted or updated row of a fact table with its own ``changeId``.
A batch writes messages, user messages and stored rows to folders named by its number,
so a batch that is run again after a failure replaces what it wrote before. It then reads the
school as it was at its first try (``pinned``), so all its outputs agree; a later batch reads
the school anew and knows the staff, students, marks and administrators of that moment.

A change that is delivered again, however much later, is dropped by its entry in the ledger
beside the outputs (``ledger``). One without a ``changeId`` cannot be told from another: it never
is dropped, and its messages are named by the batch and its content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tasktrail.plans.alerts import attendance_alerts, evaluation_alerts
from tasktrail.sources.schemas import TABLES
from tasktrail.sources.school import School
from tasktrail.sources.shared_folder import shared_folder
from tasktrail.sources.sinks import delete, write_alerts, write_batch
from tasktrail.streaming.ledger import Ledger
from tasktrail.streaming.pinned import PinnedSchools

_ALERTS = {"attendance": attendance_alerts, "task_evaluations": evaluation_alerts}


# Bounds what one batch writes aside while its outputs are written.
FILES_PER_BATCH = 1000



def change_feed(
    spark: SparkSession, folder: str, table: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    reader = spark.readStream.schema(TABLES[table])
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_deliveries(changes: DataFrame, remember: str) -> DataFrame:
    """Drop a change that was delivered before.

    Ids are remembered for at least ``remember`` after their arrival, which bounds the
    state. Time is the arrival, not the date in the row: an old attendance record that
    is entered today is not late and must not be lost. A change without an id cannot be told
    from another, so all of them pass.
    """
    known = F.col("changeId").isNotNull()
    once = (
        changes.filter(known)
        .withColumn("_arrival", F.current_timestamp())
        .withWatermark("_arrival", remember)
        .dropDuplicatesWithinWatermark(["changeId"])
        .drop("_arrival")
    )
    return once.unionByName(changes.filter(~known))


def alert_stream(
    changes: DataFrame,
    school: Callable[[], School],
    table: str,
    folder: str,
    checkpoint: str | None = None,
    remember: str | None = None,
    once: bool = True,
    ledger: bool = True,
) -> StreamingQuery:
    """Start the alerts for ``changes`` of ``table`` (attendance or task_evaluations).

    ``school`` is called for every batch and returns the school as it is then, usually
    ``lambda: School.read(spark, folder)``. ``checkpoint`` defaults to a folder below
    ``spark.checkpoint.dir`` that belongs to this table and output folder. Repeated
    deliveries are dropped by the ``ledger``; False switches it off for a feed that repeats
    nothing. ``remember`` drops those of that time beforehand, from state that the query keeps.
    ``once`` takes what is there and ends; otherwise the query runs until it is stopped.
    """
    spark = changes.sparkSession
    build = _ALERTS[table]
    if checkpoint is None:
        shared = shared_folder(spark)
        if shared is None:
            raise ValueError("set spark.checkpoint.dir or give a checkpoint")
        own = hashlib.sha256(folder.rstrip("/").encode()).hexdigest()[:16]
        checkpoint = f"{shared.rstrip('/')}/alerts-{table}-{own}"
    if remember is not None:
        changes = first_deliveries(changes, remember)

    taken = Ledger(spark, f"{folder.rstrip('/')}/ledger")
    pinned = PinnedSchools(spark, f"{folder.rstrip('/')}/pinned", table)

    def write(batch: DataFrame, number: int) -> None:
        # Several outputs read the changes; written, the batch is taken from its source once, and
        # no executor keeps it.
        staged = write_batch(batch, folder, "staged", number)
        try:
            changes = spark.read.schema(batch.schema).parquet(staged)
            fresh = changes
            if ledger:
                fresh = taken.fresh(changes, number, taken.repeated(changes, number))
            alerts = build(pinned.school(school, fresh, number), fresh, str(number))
            write_alerts(alerts, folder, number)
            if ledger:
                taken.add(fresh.select("changeId"), number)
        finally:
            delete(spark, staged)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
