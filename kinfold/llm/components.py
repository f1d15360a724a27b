"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, scratch, stash


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node links its larger (or its smaller) neighbours to the least node among its neighbours and itself.

    The least neighbour comes from one aggregation that is combined before its shuffle, so no node's neighbours
    need to meet in one task; the join that follows can be split where a node has many.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    found = both.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k"))
    if larger:
        found = found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        found = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


@scratch
def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; edges has two columns, u and v. The least node names a component."""
    edges = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    mark = None
    while True:
        done = stash(_star(_star(edges, True), False), "edges")
        now = tuple(done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_stash(edges)
        edges = done
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
