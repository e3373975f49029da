"""Connected components by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges; root is the smallest node of its component.

    Alternates the large-star and small-star steps: each node's neighbours are linked to the smallest
    one among them and itself, first from the larger side, then from the smaller. Every round is
    written to the shared folder; rounds grow with the logarithm of the longest chain. Null ends and
    loops are left out; repeated edges don't matter.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u < v").distinct()
    e, last = written(e, "edges"), None
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        # large star: larger neighbours y of x go to the least of x and its neighbours
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        large = written(large, "large-star")
        # small star: smaller neighbours and the node itself go to the least smaller neighbour
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v").unionByName(low.select(F.col("m").alias("u"), "v")).distinct()
        e = written(small, "small-star")
        # sums of hashes stand for the edge set: once it stays the same, all edges are stars
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
