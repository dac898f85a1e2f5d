"""Ids of all changes that a stream has taken, for as long as its outputs exist.

The ledger lies beside the outputs. Each batch adds a folder with its ids, dealt to buckets
by a hash of the id, and a Bloom filter per bucket: bitmaps of ``SEGMENTS`` segments, of which
a batch keeps only those it touches. A new batch tests its ids against the filters and opens
only the buckets of earlier batches that may hold one of them; there an anti join on the ids
themselves decides. So a change delivered again years later is found, and what a batch reads
follows its own repeats, not the length of the history.

Every ``RUN`` batches their folders are merged into one run, ids by bucket and filters by OR,
so that listings stay short; each id is moved once.

A batch that is run again replaces its folder and looks only at earlier ones, so it takes the
same changes as before. Changes without an id are no entries; they always pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasktrail.operators import lookups
from tasktrail.sources.school import row_width

BUCKETS = 64
SEGMENTS = 32
# Fixed by the bitmap functions.
SEGMENT_BITS = 32_768
# Places per id.
PLACES = 4
# Batches that are merged into one run.
RUN = 64

_FILTERS = "bucket int, segment int, bits binary"


class Ledger:
    """The ids of taken changes below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = path
        self._path = lambda name: path(f"{self.folder}/{name}" if name else self.folder)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(conf)

    def _complete(self) -> dict[str, tuple[int, int]]:
        """Names of folders whose filters, which come last, are written; first and last batch."""
        if not self._files.exists(self._path("")):
            return {}
        names = [status.getPath().getName() for status in self._files.listStatus(self._path(""))]
        found = {}
        for name in names:
            first, dash, last = name.partition("-")
            if first.isdigit() and last.isdigit():
                if self._files.exists(self._path(f"{name}/filters/_SUCCESS")):
                    found[name] = int(first), int(last)
        return found

    def sources(self, before: int) -> list[str]:
        """The folders that hold the batches before one; runs stand for their batches."""
        complete = self._complete()
        runs = [span for span in complete.values() if span[0] != span[1]]
        return sorted(
            name
            for name, (first, last) in complete.items()
            if last < before
            and not any(
                low <= first and last <= high and (low, high) != (first, last) and high < before
                for low, high in runs
            )
        )

    def fresh(
        self, changes: DataFrame, batch: int, repeated: DataFrame | None = None
    ) -> DataFrame:
        """The changes that no earlier batch took, one of each id, and all without an id.

        Of several with one id in the batch the least by its columns is taken, so a rerun
        takes the same. The rows are shuffled once, before any sort: sorted where they are
        read, a batch of large files would spill there. Given the few ids that are ``repeated``
        in the batch, only their rows are shuffled; ``changes`` is read twice then.
        """
        if repeated is None:
            once = _least(changes)
        else:
            columns, few = changes.columns, F.broadcast(repeated)
            alone = changes.join(few, "changeId", "left_anti").select(*columns)
            once = alone.unionByName(_least(changes.join(few, "changeId", "left_semi").select(*columns)))
        seen = self.seen(once.select("changeId").filter(F.col("changeId").isNotNull()), batch)
        return once if seen is None else once.join(seen, "changeId", "left_anti")

    def repeated(self, changes: DataFrame, batch: int) -> DataFrame | None:
        """The ids that several changes of a batch have, written beside the ledger; None if
        they are too many to broadcast, as measured. Shuffles the ids alone."""
        known = changes.select("changeId").filter(F.col("changeId").isNotNull())
        several = known.groupBy("changeId").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
        beside = f"{self.folder}-repeated"
        path = f"{beside}/batch={batch}"
        several.select("changeId").write.mode("overwrite").parquet(path)
        for status in self._files.listStatus(self._at(beside)):
            # A later batch has begun, so an earlier one is done.
            if int(status.getPath().getName().removeprefix("batch=")) < batch:
                self._files.delete(status.getPath(), True)
        found = self.spark.read.schema("changeId string").parquet(path)
        size = found.agg(F.sum(row_width(found))).first()[0] or 0
        return found if size <= lookups.BROADCAST_BYTES else None

    def seen(self, ids: DataFrame, batch: int) -> DataFrame | None:
        """Those ids that earlier batches took; None if no bucket may hold one."""
        sources = self.sources(batch)
        if not sources:
            return None
        filters = self._read(sources, "filters", _FILTERS)
        # A bitmap is some kilobytes: the few places of the batch travel, not the bitmaps.
        asked = _places(ids).groupBy("bucket", "segment").agg(
            F.collect_set(F.struct("changeId", "place", "bit")).alias("asked")
        )
        hit = (
            filters.join(asked, ["bucket", "segment"])
            .select("source", "bucket", "bits", F.explode("asked").alias("one"))
            .filter(_bit_is_set("bits", "one.bit"))
            .groupBy("source", "bucket", "one.changeId")
            .agg(F.count("*").alias("places"))
            .filter(F.col("places") == PLACES)
        )
        # At most one row per folder and bucket.
        opened = hit.select("source", "bucket").distinct().collect()
        paths = [f"{self.folder}/{row['source']}/ids/bucket={row['bucket']}" for row in opened]
        if not paths:
            return None
        taken = self.spark.read.schema("changeId string").parquet(*paths)
        return taken.join(ids, "changeId", "left_semi")

    def add(self, ids: DataFrame, batch: int) -> None:
        """Enter the ids of a batch, in place of what an earlier try of it entered."""
        name = f"{batch}-{batch}"
        self._write(
            name,
            ids.filter(F.col("changeId").isNotNull()).select("changeId", _bucket().alias("bucket")),
        )
        ids = self.spark.read.schema("changeId string, bucket int").parquet(
            f"{self.folder}/{name}/ids"
        )
        self._filters(name, _bitmaps(_places(ids.select("changeId"))))
        if (batch + 1) % RUN == 0:
            self.merge(batch + 1 - RUN, batch)

    def merge(self, first: int, last: int) -> None:
        """Make one run of the single batches from ``first`` to ``last``; drop their folders."""
        spans = self._complete()
        names = [n for n, (low, high) in spans.items() if low == high and first <= low <= last]
        if len(names) < 2:
            return
        run = f"{first}-{last}"
        self._write(run, self._read(names, "ids", "changeId string, bucket int"))
        filters = self._read(names, "filters", _FILTERS)
        merged = filters.groupBy("bucket", "segment").agg(F.bitmap_or_agg("bits").alias("bits"))
        self._filters(run, merged)
        for name in names:
            self._files.delete(self._path(name), True)

    def _read(self, names: list[str], part: str, schema: str) -> DataFrame:
        """One part of some folders with the name of its ``source``."""
        reader = self.spark.read.schema(schema)
        tables = [
            reader.parquet(f"{self.folder}/{name}/{part}").withColumn("source", F.lit(name))
            for name in names
        ]
        return reduce(DataFrame.unionAll, tables)

    def _write(self, name: str, ids: DataFrame) -> None:
        # Filters mark a folder as complete, so those of an earlier try go first.
        self._files.delete(self._path(name), True)
        rows = ids.select("changeId", "bucket").repartition("bucket")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}/ids")

    def _filters(self, name: str, bitmaps: DataFrame) -> None:
        # A shuffle of at most 8 MB; coalesced, one task would also make all of them.
        bitmaps.repartition(1).write.mode("overwrite").parquet(f"{self.folder}/{name}/filters")


def _least(changes: DataFrame) -> DataFrame:
    """Of the changes with one id the least by its columns; all without an id."""
    others = [name for name in changes.columns if name != "changeId"]
    # A change without an id is a group of its own.
    alone = F.when(F.col("changeId").isNull(), F.monotonically_increasing_id())
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("changeId", "_alone"), F.lit(parts)).cast("int")
    return (
        changes.withColumn("_alone", alone)
        .withColumn("_part", part)
        .repartitionById(parts, "_part")
        .groupBy("_part", "changeId", "_alone")
        .agg(F.min(F.struct(*others)).alias("row"))
        .select(*(F.col("changeId") if c == "changeId" else F.col(f"row.{c}") for c in changes.columns))
    )


def _bucket() -> Column:
    return F.pmod(F.xxhash64("changeId"), F.lit(BUCKETS)).cast("int")


def _places(ids: DataFrame) -> DataFrame:
    """``PLACES`` bits of each id in the filter of its bucket."""
    spots = [
        F.struct(
            F.lit(place).alias("place"),
            F.pmod(F.xxhash64("changeId", F.lit(place)), F.lit(SEGMENTS * SEGMENT_BITS)).alias("spot"),
        )
        for place in range(PLACES)
    ]
    each = ids.select("changeId", _bucket().alias("bucket"), F.explode(F.array(*spots)).alias("at"))
    spot = F.col("at.spot")
    return each.select(
        "changeId",
        "bucket",
        F.col("at.place").alias("place"),
        F.floor(spot / SEGMENT_BITS).cast("int").alias("segment"),
        (spot % SEGMENT_BITS).alias("bit"),
    )


def _bitmaps(places: DataFrame) -> DataFrame:
    """One bitmap per bucket and segment.

    The bitmap functions sort their input, so places first meet in words of 64 bits, by a hash
    aggregate that holds at most the words of the filters: as many ids as there are, few rows go on.
    """
    word = F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word")
    words = places.groupBy("bucket", "segment", F.floor(F.col("bit") / 64).alias("at")).agg(word)
    ones = F.expr("filter(sequence(0, 63), one -> (shiftrightunsigned(word, one) & 1L) = 1L)")
    bits = words.repartitionById(BUCKETS, "bucket").select("bucket", "segment", "at", F.explode(ones).alias("one"))
    bit = F.col("at") * 64 + F.col("one")
    return bits.groupBy("bucket", "segment").agg(F.bitmap_construct_agg(bit).alias("bits"))


def _bit_is_set(bits: str, bit: str) -> Column:
    byte = f"cast(conv(hex(substring({bits}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"(({byte} >> cast({bit} % 8 as int)) & 1) = 1")
