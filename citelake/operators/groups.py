"""Groups of keys that belong together, as connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, spread, written


def groups(links: DataFrame) -> DataFrame:
    """(node, group) for every node of `links` (a, b); group: the smallest node reachable. Loops and repeated links are allowed.

    Each round gives every node the least of what its neighbours have, then what that one has by now, so groups of any length close in
    few rounds. Only the least of a node's neighbours is kept, never a list of them.
    """
    e = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).union(links.select("a", "a")).union(links.select("b", "b")).distinct(), "links")
    at = written(e.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("group")), "groups")
    while True:
        near = e.join(spread(at.select(F.col("node").alias("y"), "group")), "y").groupBy(F.col("x").alias("node")).agg(F.min("group").alias("near"))
        far = at.select(F.col("node").alias("near"), F.col("group").alias("far"))
        new = written(near.join(spread(far), "near", "left").select("node", F.least("near", "far").alias("group")), "groups")
        still = new.join(spread(at.withColumnRenamed("group", "old")), "node").filter("group <> old").isEmpty()
        drop(at)
        at = new
        if still:
            drop(e)
            return at


def grouped_by(links: DataFrame) -> DataFrame:
    """(node, group, new) for every a of `links` (a, b, new); b may be null. Those that share a b, also by way of others, are of one group; new: whether any link of the node is.

    Only an a with several b joins them, so the rounds of `groups` run over such b alone: most nodes have their group after one pass.
    """
    own = written(links.groupBy("a", "b").agg(F.max("new").alias("new")), "links")
    ends = written(own.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("new").alias("new")), "nodes")
    edges = written(own.join(spread(ends.filter("low < high").select("a", "low")), "a").filter("b > low").select(F.col("low").alias("a"), "b"), "edges")
    drop(own)
    if edges.isEmpty():
        return ends.select(F.col("a").alias("node"), F.coalesce("low", "a").alias("group"), "new")
    out = ends.join(spread(groups(edges).withColumnRenamed("node", "low")), "low", "left")
    return out.select(F.col("a").alias("node"), F.coalesce("group", "low", "a").alias("group"), "new")
