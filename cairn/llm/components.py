"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its smallest neighbour to its larger (large) or smaller neighbours; the minimum is combined before the shuffle and joined back."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")  # a table, so that Spark can split the join of a node with very many edges
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any integer ids to (id, component): each id that has an edge, and the smallest id that it reaches.

    Null ends and self-loops are no edges; repeated edges count once; no edges give no rows. Rounds grow with the logarithm of the longest path.
    """
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = written(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
