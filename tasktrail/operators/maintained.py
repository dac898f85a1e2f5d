"""Latest attempts and first presentations kept up to date by batches of changes.

A report over the whole fact looks for the latest date of every staff, student and task anew.
Here that is kept beside the fact: ``moments`` counts the equal attempts by the columns a
progress report reads and marks those on the ``latest`` date of their key. They lie in
buckets by student. A batch rewrites the buckets it touches from their last version and its
own changes, so work follows the batch; the fact is not read. Since all moments are kept,
attempts can be taken back: the latest date falls to the one before.

``batch=N/touched`` lists the buckets of a batch. It is written last, so a batch without it does not
count, and a batch that is run again replaces its folder and starts from the batches
before it. Readers take each bucket from the last batch that touched it.

A rewrite shuffles its rows once: a bucket goes to as many tasks as its share of the rows asks
for, by staff, student and task, and each task counts its moments, marks the latest and writes
them. So a hot student is spread over the tasks of its bucket; the attempts of one key meet in
one task, which holds them as counted moments and spills what does not fit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tasktrail.functions.filters import all_known
from tasktrail.operators.attempts import ATTEMPT_KEY
from tasktrail.sources.schemas import TABLES
from tasktrail.sources.versions import ROW_KEYS, latest_versions

# Some hundred megabytes a bucket; a folder keeps the number it was begun with.
BUCKETS = 64
MOMENT = ("studentId", "staffId", "taskId", "evaluationId", "evaluationTypeId", "evaluationDate")
# Copies of a moment that are made at a time.
COPIES = 4096
# Rows of a rewrite that a task takes, some hundred bytes each in memory.
ROWS_PER_TASK = 500_000

_SCHEMA = T.StructType(
    [*(TABLES["task_evaluations"][name] for name in MOMENT), T.StructField("rows", T.LongType())]
)
_MARKED = T.StructType([*_SCHEMA.fields, T.StructField("latest", T.BooleanType())])
_TOUCHED = "batch long, bucket int, buckets int"


class MaintainedAttempts:
    """The maintained tables below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.buckets = buckets
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}" if name else self.folder)
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def add(self, batch: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Enter attempts and take attempts back; each row stands for one row of the fact.

        Nulls are values like others. Attempts taken back that are not there (yet) are owed:
        they cancel later ones and are not seen by readers. The frames are read twice, first
        for the buckets they touch, and have to give the same rows.
        """
        signed = [
            rows.select(*MOMENT, F.lit(sign).cast("long").alias("rows"))
            for rows, sign in ((added, 1), (removed, -1))
            if rows is not None
        ]
        if not signed:
            raise ValueError("neither added nor removed attempts")
        both = signed[0] if len(signed) == 1 else signed[0].unionAll(signed[1])
        self._rewrite(batch, both, both, DataFrame.unionAll)

    def store(self, batch: int, versions: DataFrame) -> None:
        """Enter stored versions of rows: the last one of each key replaces all rows of that key.

        Keys and order are those of ``sources/versions.py``.
        """
        if "batch" not in versions.columns:
            versions = versions.withColumn("batch", F.lit(batch).cast("long"))
        if "changeId" not in versions.columns:
            versions = versions.withColumn("changeId", F.lit(None).cast("string"))
        keys = ROW_KEYS["task_evaluations"]
        last = latest_versions(versions.select(*MOMENT, "changeId", "batch"), keys)

        def replace(old: DataFrame, changes: DataFrame) -> DataFrame:
            named = changes.select(*(F.col(key).alias(f"_{key}") for key in keys))
            same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
            return old.join(named, same, "left_anti").unionAll(changes)

        changes = last.select(*MOMENT, F.lit(1).cast("long").alias("rows"))
        self._rewrite(batch, versions, changes, replace)

    def moments(self, upto: int | None = None) -> DataFrame:
        """Distinct attempts with their number of ``rows``, after batch ``upto`` or all."""
        return self._read(self._newest(upto)).filter(F.col("rows") > 0).select(*_SCHEMA.names)

    def attempts(self, upto: int | None = None) -> DataFrame:
        """All attempts in the columns of a progress report, as many rows as the fact has."""
        return _each(self.moments(upto))

    def latest(self, upto: int | None = None) -> DataFrame:
        """The latest attempts per staff, student and task; ties and copies all stay.

        What ``latest_attempts`` finds in the fact, without rows of null keys or dates.
        """
        return _each(self._read(self._newest(upto)).filter("latest").select(*_SCHEMA.names))

    def forget(self) -> None:
        """Delete buckets that later batches replace; for a time without running readers."""
        newest = self._newest(None)
        for batch in self._complete():
            kept = {f"bucket={bucket}" for bucket, last in newest.items() if last == batch}
            for name in self._buckets(batch) - kept:
                self._files.delete(self._path(f"batch={batch}/moments/{name}"), True)
            if not kept:
                self._files.delete(self._path(f"batch={batch}"), True)

    def _rewrite(
        self,
        batch: int,
        given: DataFrame,
        changes: DataFrame,
        merge: Callable[[DataFrame, DataFrame], DataFrame],
    ) -> None:
        """Write the buckets of ``given``, from which ``changes`` are made, after ``merge`` with them."""
        newest = self._newest(batch - 1)
        own = f"batch={batch}"
        self._files.delete(self._path(own), True)
        # At most one row per bucket.
        counts = given.groupBy(self._bucket()).agg(F.count("*").alias("rows")).collect()
        touched = [row["bucket"] for row in counts]
        old = self._read({bucket: newest[bucket] for bucket in touched if bucket in newest})
        old = old.select(*_SCHEMA.names)
        rows = sum(row["rows"] for row in counts) + old.count()
        parts = max(1, -(-rows // (ROWS_PER_TASK * max(1, len(touched)))))
        made = self._marked(merge(old, changes), parts)
        writer = made.write.partitionBy("bucket").option("compression", "zstd")
        writer.parquet(f"{self.folder}/{own}/moments")
        listed = self.spark.createDataFrame([(batch, one, self.buckets) for one in touched], _TOUCHED)
        listed.coalesce(1).write.parquet(f"{self.folder}/{own}/touched")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("studentId"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _marked(self, rows: DataFrame, parts: int) -> DataFrame:
        """The moments of ``rows``, counted and marked, each bucket in ``parts`` tasks."""
        part = F.pmod(F.xxhash64(*ATTEMPT_KEY), F.lit(parts)).cast("int")
        dealt = rows.withColumn("_task", self._bucket() * parts + part)
        dealt = dealt.repartitionById(self.buckets * parts, "_task")
        # All that follows stays within the task: its moments, the latest dates, the order.
        moments = dealt.groupBy("_task", *MOMENT).agg(F.sum("rows").alias("rows"))
        moments = moments.filter(F.col("rows") != 0)
        there = F.col("rows") > 0
        key = Window.partitionBy("_task", *ATTEMPT_KEY)
        last = F.max(F.when(there, F.col("evaluationDate"))).over(key)
        latest = there & all_known(*ATTEMPT_KEY) & (F.col("evaluationDate") == last)
        marked = moments.withColumn("latest", F.coalesce(latest, F.lit(False)))
        made = marked.select(*_MARKED.names, self._bucket())
        return made.sortWithinPartitions("bucket", "studentId", "staffId", "taskId")

    def _complete(self) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = [one.getPath().getName() for one in self._files.listStatus(self._path(""))]
        batches = [int(name.removeprefix("batch=")) for name in names if name.startswith("batch=")]
        return sorted(
            one for one in batches if self._files.exists(self._path(f"batch={one}/touched/_SUCCESS"))
        )

    def _newest(self, upto: int | None) -> dict[int, int]:
        """The last batch that touched each bucket."""
        batches = [one for one in self._complete() if upto is None or one <= upto]
        if not batches:
            return {}
        paths = [f"{self.folder}/batch={one}/touched" for one in batches]
        listed = self.spark.read.schema(_TOUCHED).parquet(*paths)
        found = listed.groupBy("bucket", "buckets").agg(F.max("batch").alias("batch")).collect()
        if any(row["buckets"] != self.buckets for row in found):
            raise ValueError(f"{self.folder} has {found[0]['buckets']} buckets, not {self.buckets}")
        return {row["bucket"]: row["batch"] for row in found}

    def _buckets(self, batch: int) -> set[str]:
        """The folders of a batch's buckets that have rows."""
        path = self._path(f"batch={batch}/moments")
        names = {one.getPath().getName() for one in self._files.listStatus(path)}
        return {name for name in names if name.startswith("bucket=")}

    def _read(self, newest: dict[int, int]) -> DataFrame:
        full = {batch: self._buckets(batch) for batch in set(newest.values())}
        paths = [
            f"{self.folder}/batch={batch}/moments/bucket={bucket}"
            for bucket, batch in sorted(newest.items())
            if f"bucket={bucket}" in full[batch]
        ]
        if not paths:
            return self.spark.createDataFrame([], _MARKED)
        return self.spark.read.schema(_MARKED).parquet(*paths)


def _each(moments: DataFrame) -> DataFrame:
    """Each moment as many times as it has rows, in blocks, so that no array grows with them."""
    blocks = moments.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES)))
    )
    size = F.least(F.lit(COPIES).cast("long"), F.col("rows") - F.col("_block") * COPIES)
    return blocks.select(*MOMENT, F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_copy")).drop("_copy")
