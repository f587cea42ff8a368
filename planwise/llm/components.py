"""Connected components of a link table by alternating star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest one around that node."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of these; links run from small a to large b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return (moved.select(F.col("m").alias("x"), F.col("a").alias("y"))
            .unionByName(moved.select(F.col("m").alias("x"), F.col("b").alias("y")))
            .where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b); the component is its smallest id."""
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "links")
    seen = None
    while True:
        total = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(total) == seen or not total[0]:
            break
        seen = tuple(total)
        links = stored(_small_star(_large_star(links)), "stars")
    return (links.select(F.col("b").alias("id"), F.col("a").alias("component"))
            .unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct())
