"""Connected components of a table of links, as alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(node, label) for every node of `links` (a, b): label is the smallest node reachable. Loops and repeated links are allowed.

    A round replaces each link by links to smaller nodes, which keeps the components; rounds end when the links are stars
    around the labels. Neighbours are never gathered in a row: minima are pre-aggregated, written and joined back, so Spark can split a hot node's links.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    e = stages.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        all_ = both(e)
        low = stages.put(all_.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = all_.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stages.put(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = stages.put(small.filter("a <> b").distinct())
        for df in (e, large, low):
            stages.drop(df)
        stages.free()
        e = new
        counts = e.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k")).first()
        if counts["n"] == counts["k"] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
