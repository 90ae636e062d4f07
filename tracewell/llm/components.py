"""Connected components by alternating large-star and small-star rounds.

Links stay in Spark throughout; every round is written to the shared folder, so
a lost executor costs one round at most. The number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_apart, materialise


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """edges: (u, v). Each u hands the least of itself and its neighbours to its
    neighbours (to those above it, if larger_only, else to itself as well)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = join_apart(edges, least, ["u"])
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) long. (node, component): for every node of a link, the least node it reaches.

    Links of a node to itself count for nothing; no links, no rows."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    while True:
        large = _to_least(_both_ways(edges), larger_only=True)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before, edges = edges, materialise(_to_least(down, larger_only=False), "links")
        discard(before)
        roots = edges.select("v").distinct()
        open_ = edges.groupBy("u").count().where("count > 1").select("u").unionByName(edges.select("u").join(roots.select(F.col("v").alias("u")), "u", "left_semi"))
        if not open_.limit(1).count():
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out._stored_at = edges._stored_at
    return out
