"""Facts as the stored row versions leave them: the latest version of each key.

``write_alerts`` and the stream append every stored version of a row, flags taken back. Reading
merges them over the table: of each key the version of the last batch counts, within a batch
the one with the highest change id (shorter ids first, then by text); rows of the table whose
key has a version give way to it. Keys compare null-safe. Equal keys of the table itself all
stay, as the reports keep them.

``compact`` writes the merged table anew, ordered by key ranges, to a folder that names the last
batch in it. Readers take the newest complete one as the table and merge only later batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tasktrail.operators import lookups
from tasktrail.sources.schemas import CLUSTERED, TABLES
from tasktrail.sources.school import School, row_width
from tasktrail.sources.shared_folder import shared_folder, written

# What names a row of a fact, whatever becomes of its other columns.
ROW_KEYS = {
    "attendance": ("studentId", "staffId", "attendanceDate"),
    "task_evaluations": ("studentId", "staffId", "taskId", "evaluationTypeId", "evaluationDate"),
}


def stored_versions(spark: SparkSession, folder: str, table: str, after: int = -1) -> DataFrame:
    """Stored versions with their ``batch``, of batches after one."""
    schema = T.StructType([*TABLES[table].fields, T.StructField("batch", T.LongType())])
    path = f"{folder.rstrip('/')}/stored"
    if not _files(spark, path).exists(_path(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("batch") > after)


def latest_versions(versions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last version of each key, by an aggregate that combines before its shuffle."""
    others = [name for name in versions.columns if name not in (*keys, "batch", "changeId")]
    # The row itself takes part in the order, so that equal ids cannot leave it open.
    order = F.struct("batch", F.length("changeId").alias("_length"), "changeId", *others)
    found = versions.groupBy(*keys).agg(F.max(order).alias("last"))
    return found.select(*keys, "last.changeId", *(f"last.{name}" for name in others))


def merged(table: DataFrame, versions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``table`` with the latest versions in place of the rows they replace.

    Most keys have one version or none. So the keys alone are shuffled first, and those of
    several versions and those of the table without one are written. Where such keys are few, as
    measured, they are broadcast and all rows stay where they lie; else the rows are shuffled.
    """
    columns = [name for name in table.columns if name in versions.columns]

    def matched(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        named = found.select(*(F.col(key).alias(f"_{key}") for key in keys))
        return rows.join(named, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys], how)

    several, bare = _odd_keys(table, versions, keys)
    if several is None:
        latest = latest_versions(versions, keys).select(*columns)
    else:
        repeated = latest_versions(matched(versions, several, "left_semi"), keys)
        once = matched(versions, several, "left_anti")
        latest = once.select(*columns).unionByName(repeated.select(*columns))
    if bare is None:
        kept = matched(table, versions, "left_anti")
    else:
        kept = matched(table, bare, "left_semi")
    return kept.select(*columns).unionByName(latest)


def _odd_keys(
    table: DataFrame, versions: DataFrame, keys: tuple[str, ...]
) -> tuple[DataFrame | None, DataFrame | None]:
    """Keys of several versions, and keys of the table without one, both to be broadcast.

    None in place of those that are too many. Without a shared folder nothing is sought.
    """
    if shared_folder(table.sparkSession) is None:
        return None, None
    listed = [
        rows.select(*keys, F.lit(count).cast("long").alias("_versions"))
        for rows, count in ((table, 0), (versions, 1))
    ]
    counted = listed[0].unionAll(listed[1]).groupBy(*keys).agg(F.sum("_versions").alias("_versions"))
    odd = written(counted.filter(F.col("_versions") != 1), "keys")
    sizes = odd.groupBy((F.col("_versions") > 1).alias("several")).agg(F.sum(row_width(odd)).alias("bytes"))
    bytes_of = {row["several"]: row["bytes"] for row in sizes.collect()}

    def few(several: bool) -> DataFrame | None:
        if bytes_of.get(several, 0) > lookups.BROADCAST_BYTES:
            return None
        return F.broadcast(odd.filter((F.col("_versions") > 1) == F.lit(several)))

    return few(True), few(False)


def read_current(spark: SparkSession, folder: str, alerts: dict[str, str]) -> School:
    """The school in ``folder`` with the facts as they are after all stored versions.

    ``alerts`` names, by fact table, the folder its alerts were written to.
    """
    school = School.read(spark, folder)
    return school.replace(
        **{table: current(spark, getattr(school, table), table, out) for table, out in alerts.items()}
    )


def current(spark: SparkSession, rows: DataFrame, table: str, alerts: str) -> DataFrame:
    """One fact after all versions stored below ``alerts``."""
    done = compacted(spark, alerts)
    base = _base(spark, rows, table, alerts, done)
    return merged(base, stored_versions(spark, alerts, table, done), ROW_KEYS[table])


def _base(spark: SparkSession, rows: DataFrame, table: str, alerts: str, done: int) -> DataFrame:
    """The compaction up to batch ``done`` if there is one, else the given rows."""
    schema = TABLES[table]
    if done >= 0:
        return spark.read.schema(schema).parquet(f"{alerts.rstrip('/')}/current/upto={done}")
    if "changeId" not in rows.columns:
        rows = rows.withColumn("changeId", F.lit(None).cast("string"))
    return rows.select(*schema.names)


def compact(spark: SparkSession, rows: DataFrame, table: str, alerts: str) -> int:
    """Write the fact after all stored versions; the last batch in it, -1 if there is none.

    ``rows`` is the table as it was before the first version. Older results stay until
    ``forget`` so that running reports can end.
    """
    done = compacted(spark, alerts)
    later = stored_versions(spark, alerts, table, done)
    last = later.agg(F.max("batch")).first()[0]
    if last is None:
        return done
    columns = CLUSTERED[table]
    # A stream may store more while this runs: what is written holds batches up to `last`.
    versions = later.filter(F.col("batch") <= last)
    base = _base(spark, rows, table, alerts, done)
    made = merged(base, versions, ROW_KEYS[table])
    ordered = made.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ordered.write.mode("overwrite").parquet(f"{alerts.rstrip('/')}/current/upto={last}")
    return last


def compacted(spark: SparkSession, alerts: str) -> int:
    """The last batch of the newest complete compaction, -1 without one."""
    path = f"{alerts.rstrip('/')}/current"
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return -1
    found = [status.getPath() for status in files.listStatus(_path(spark, path))]
    return max(
        (
            int(one.getName().removeprefix("upto="))
            for one in found
            if files.exists(_path(spark, f"{one}/_SUCCESS"))
        ),
        default=-1,
    )


def forget(spark: SparkSession, alerts: str) -> None:
    """Delete compactions that a newer one replaces."""
    done = compacted(spark, alerts)
    path = f"{alerts.rstrip('/')}/current"
    files = _files(spark, path)
    if done < 0:
        return
    for status in files.listStatus(_path(spark, path)):
        if int(status.getPath().getName().removeprefix("upto=")) < done:
            files.delete(status.getPath(), True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
