"""Connected components of an edge table by alternating large and small stars.

Every round is two group-minimum joins on DataFrames; lineage is cut in the shared checkpoint folder.
Nothing but a row count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.llm.frames import settle


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, component), the component being the smallest node reachable.

    Only nodes with a link to another node appear. Repeated links, both directions and self-links are
    fine; links with a null end are ignored. An empty table gives an empty table.
    """
    a, b = F.col("a"), F.col("b")
    now = settle(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        now = settle(_small_star(_large_star(now)))
    centres = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node in its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (a > b in every row)."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
