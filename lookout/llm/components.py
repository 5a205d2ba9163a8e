"""Connected components of a table of links, by alternating star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import settled


def star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node points its larger (large) or smaller (small) neighbours at its smallest one.

    The smallest neighbour combines map-side; joining it back is a join on one row per node, which adaptive execution
    splits at hubs.
    """
    back = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    both = back.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else back
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        found = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        found = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return found.where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) with a < b for every node b that is not the smallest of its component, a being the smallest."""
    links = settled(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return links
        seen = now
        links = settled(star(star(links, large=True), large=False))
