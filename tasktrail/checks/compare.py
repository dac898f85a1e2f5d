"""Run registered queries and their SQL side by side.

    python -m tasktrail.checks.compare [sf0.01] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def spark_rows(result: DataFrame) -> tuple[list[str], Counter]:
    columns = sorted(result.columns)
    return columns, Counter(tuple(row) for row in result.select(*columns).collect())


def sql_rows(connection: duckdb.DuckDBPyConnection, statement: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(statement)
    names = [column[0] for column in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    return [names[i] for i in order], rows


def difference(left: tuple[list[str], Counter], right: tuple[list[str], Counter]) -> str | None:
    """None if both results hold the same rows, else what differs."""
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if left[1] != right[1]:
        only_left, only_right = left[1] - right[1], right[1] - left[1]
        return (
            f"{left[1].total()} against {right[1].total()} rows; "
            f"{only_left.total()} only left, {only_right.total()} only right; "
            f"{list(only_left)[:2]} {list(only_right)[:2]}"
        )
    return None


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(arguments: list[str]) -> int:
    from tasktrail.checks.oracle import statements
    from tasktrail.checks.registry import registered

    folder = f"/root/testdata/{arguments[0] if arguments else 'sf0.01'}"
    wanted = arguments[1:]
    spark, connection = session(), connect(folder)
    queries, sql = registered(), statements()
    print("without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    failures = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        left = spark_rows(query(spark, folder))
        spent = time.time() - started
        problem = difference(left, sql_rows(connection, sql[name]))
        failures += problem is not None
        print(f"{name}: {left[1].total()} rows {spent:.2f} s {problem or 'equal'}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
