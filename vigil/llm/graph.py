"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import store


def _nearest(pairs: DataFrame, name: str) -> DataFrame:
    """(u, v) with the least of u and its neighbours; stored, so that a hot u can be split in the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(store(least, name), "u")


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b); component is the least vertex reachable.

    Every step joins each edge to the least neighbour of its end; stars remain
    after a number of steps logarithmic in the longest path.
    """
    edges = store(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both, "large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "large-star")
        star = _nearest(large, "small")
        small = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            star.select("u", F.col("m").alias("v"))).distinct()
        small = store(small, "small-star")
        same = [df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % (1 << 40))).first() for df in (edges, small)]
        edges = small
        if same[0] == same[1]:
            break
    stars = edges.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("v"), "component").distinct())
