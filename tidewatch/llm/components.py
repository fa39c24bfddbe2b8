"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge table with integer ends; root is the component's least node.

    Alternates large-star and small-star steps: each links nodes to the least neighbour, keeps the
    components and at most the number of edges, and settles in about log(diameter) rounds. A hub's
    edges are a sorted stream in its window, never an array. Every round is a written table.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    before = None
    while True:
        # large star: every greater neighbour of u, and u itself, to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        least = both.withColumn("m", F.least(F.min("v").over(w), F.col("u")))
        large = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every lesser neighbour of u, and u, to the least of them
        low = large.withColumn("m", F.min("v").over(w))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialise(small, "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
