"""The school tables as one object that every report takes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasktrail.functions.filters import YEAR
from tasktrail.sources.schemas import CLUSTERED, DATED, MEASURED, TABLES


class School:
    """Named school tables, read lazily, with measured sizes of the smaller ones.

    Tables are attributes: ``school.students`` is a DataFrame. Columns are cut to the
    declared schema and cast to it. ``later`` makes further tables when they are first read.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        later: Mapping[str, Callable[[], DataFrame]] | None = None,
    ):
        self._later = {name: make for name, make in (later or {}).items() if name not in tables}
        unknown = {*tables, *self._later} - set(TABLES)
        if unknown:
            raise ValueError(f"not a school table: {sorted(unknown)}")
        self._tables = {name: _conform(name, table) for name, table in tables.items()}
        self._known: dict = {}

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> School:
        """Read the Parquet table ``folder/<name>.parquet`` for every school table."""
        return cls({name: _read(spark, f"{folder}/{name}.parquet", name) for name in TABLES})

    def write(self, folder: str) -> None:
        """Write the tables for ``read``: facts in folders by year, large ones ordered by student.

        A dated report reads the folders of its years. Each file and row group covers few
        students, and the report of one student skips the others by their statistics. A
        student with very many rows still spreads over several files, because the second
        column takes part in the split.
        """
        for name in {**self._tables, **self._later}:
            table = getattr(self, name)
            path, columns = f"{folder}/{name}.parquet", list(CLUSTERED.get(name, ()))
            if name in DATED:
                columns = [YEAR, *columns]
                table = table.withColumn(YEAR, F.year(DATED[name]))
            if columns:
                table = table.repartitionByRange(*columns).sortWithinPartitions(*columns)
            writer = table.write.partitionBy(YEAR) if name in DATED else table.write
            writer.parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._tables and name in self._later:
            self._tables[name] = _conform(name, self._later[name]())
        if name not in self._tables:
            raise AttributeError(f"this school has no table {name}")
        return self._tables[name]

    def replace(self, **tables: DataFrame) -> School:
        """The same school with some tables exchanged; only these are counted anew."""
        made = School({**self._tables, **tables}, self._later)
        if not set(tables) & set(MEASURED) and "_sizes" in self.__dict__:
            made.__dict__["_sizes"] = self._sizes
        return made

    @cached_property
    def _sizes(self) -> dict[str, tuple[int, int]]:
        measured = [
            self._tables[name].select(F.lit(name).alias("name"), row_width(self._tables[name]).alias("width"))
            for name in MEASURED
            if name in self._tables and name not in self._later
        ]
        sizes = (
            reduce(DataFrame.unionAll, measured)
            .groupBy("name")
            .agg(F.count("*").alias("rows"), F.sum("width").alias("bytes"))
        )
        found = {row["name"]: (row["rows"], row["bytes"]) for row in sizes.collect()}
        return {name: (0, 0) for name in MEASURED if name not in self._later} | found

    def _measure(self, name: str, table: DataFrame) -> None:
        row = table.agg(F.count("*").alias("rows"), F.sum(row_width(table)).alias("bytes")).first()
        self._sizes[name] = (row["rows"], row["bytes"] or 0)

    def _measured(self, name: str) -> tuple[int, int]:
        if name not in self._sizes and name in MEASURED:
            self._measure(name, getattr(self, name))
        return self._sizes[name]

    def rows(self, name: str) -> int:
        """Measured row count of a table that may be broadcast."""
        return self._measured(name)[0]

    def size(self, name: str) -> int:
        """Measured bytes of a table that may be broadcast: what its rows take in memory.

        One job measures all of them once per school, and one each of the tables made later;
        of text columns it reads lengths.
        """
        return self._measured(name)[1]

    def known(self, name: str, find: Callable):
        """What ``find`` returns, found once per school under ``name``."""
        if name not in self._known:
            self._known[name] = find()
        return self._known[name]

    def size_of(self, name: str, table: DataFrame) -> int:
        """Bytes of a small derived lookup, measured once per school under ``name``."""
        if name not in self._sizes:
            self._measure(name, table)
        return self._sizes[name][1]


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # A fact in folders by year without any row has no file to tell its columns.
        if name not in DATED or error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], TABLES[name])


def row_width(table: DataFrame) -> Column:
    """Bytes of a row in memory: eight a column, texts in full, and eight for null marks."""
    texts = [F.octet_length(name) for name, kind in table.dtypes if kind == "string"]
    fixed = F.lit(8 + 8 * len(table.columns)).cast("long")
    return reduce(lambda one, other: one + F.coalesce(other, F.lit(0)), texts, fixed)


def _conform(name: str, table: DataFrame) -> DataFrame:
    fields = TABLES[name].fields
    have = dict(table.dtypes)
    return table.select(
        *(
            F.col(field.name)
            if have.get(field.name) == field.dataType.simpleString()
            else F.col(field.name).cast(field.dataType)
            for field in fields
            if field.name in have or field.name != "changeId"
        ),
        *([F.col(YEAR).cast("int").alias(YEAR)] if name in DATED and YEAR in have else []),
    )
