"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on undirected edges (u > v), both sides of which are stored tables so that hot nodes can be split."""
    both = edges if not large else edges.union(edges.select("v", "u").toDF("u", "v"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = both.join(least.hint("merge"), "u")
    if large:  # larger neighbours move to the least of u and its neighbours
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:  # u and its smaller neighbours move to the least of them
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return stored(moved.distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (columns a, b; any order, repeats allowed): the least node reachable.

    Self links and links with a null end are left out; no links, no rows. Each round writes its edges to the shared
    folder and the last round's are dropped. The rounds needed grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, "edges")
    facts = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == facts or seen[0] == 0:
            break
        facts = seen
        before, now = now, _star(_star(now, True), False)
        remove(spark, before)
    # every node now points at the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
