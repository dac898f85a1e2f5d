"""Connected components of a table of links, by stars that shrink towards their smallest node.

Alternating large and small stars (Kiveris and others, 2014): every round replaces links
by links to the smallest neighbour. The minimum is a partial aggregate, and it meets the
links again in a join over lanes, so a node with very many links is neither gathered in
one task nor sent to one. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasktrail.llm.common import written
from tasktrail.operators.lookups import spread_join


def _links(table: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return table.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter(F.col("a") != F.col("b"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("_least"))
    smallest = smallest.select("a", F.least("a", "_least").alias("_least"))
    larger = both.filter(F.col("b") > F.col("a"))
    return _links(spread_join(larger, smallest, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("a").agg(F.min("b").alias("_least"))
    others = spread_join(links, smallest, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return _links(others.unionByName(smallest.withColumnRenamed("_least", "b")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every linked node but roots.

    ``links`` has columns ``a`` and ``b``; a link to itself or twice does no harm.
    """
    links = written(_links(links.select("a", "b")).distinct(), "links")
    before = _state(links)
    while before[0]:
        links = written(_large_star(links).distinct(), "links")
        links = written(_small_star(links).distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
