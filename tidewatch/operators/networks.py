"""Correlation networks of series: distances and their minimum spanning trees."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_distances(df: DataFrame, window: str, x: str) -> DataFrame:
    """window, a, b, distance sqrt(2 (1 - |rho|)) of every two series with values in a window."""
    r = df.where(F.col(x).isNotNull()).select(window, "series_id", "ts", x)
    a = r.withColumnRenamed("series_id", "a").withColumnRenamed(x, "_x")
    b = r.withColumnRenamed("series_id", "b").withColumnRenamed(x, "_y")
    rho = a.join(b, [window, "ts"]).where("a < b").groupBy(window, "a", "b").agg(F.corr("_x", "_y").alias("rho"))
    return rho.where("rho is not null and not isnan(rho)").select(window, "a", "b", F.sqrt(F.greatest(2 * (1 - F.abs("rho")), F.lit(0.0))).alias("distance"))


def h0_persistence(df: DataFrame, window: str, x: str) -> DataFrame:
    """window, total (the finite H0 persistence of a window's network: its minimum spanning tree's weight) and score.

    A window's network has a row a pair of series, few of them: the tree is grown in one Arrow call a
    window. score is minus the robust z of the total against the windows before (median, 1.4826 MAD).
    """

    def tree(table: pa.Table) -> pa.Table:
        up: dict[str, str] = {}

        def root(n: str) -> str:
            while up.setdefault(n, n) != n:
                n = up[n]
            return n

        total = 0.0
        for d, a, b in sorted(zip(*(table.column(c).to_pylist() for c in ("distance", "a", "b")))):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[ra] = rb
                total += d
        return pa.table({window: table.column(window).slice(0, 1), "total": [total]})

    kind = df.schema[window].dataType.simpleString()
    g = pair_distances(df, window, x).groupBy(window).applyInArrow(tree, f"{window} {kind}, total double")
    past = Window.partitionBy(F.lit(0)).orderBy(window).rowsBetween(Window.unboundedPreceding, -1)  # one row a window
    g = g.withColumn("_v", F.collect_list("total").over(past))
    place = lambda c, k: F.element_at(F.array_sort(c), (F.floor((F.size(c) + k) / 2)).cast("int"))
    median = lambda c: (place(c, 1) + place(c, 2)) / 2
    g = g.withColumn("_m", F.when(F.size("_v") >= 4, median(F.col("_v"))))
    mad = 1.4826 * median(F.transform("_v", lambda t: F.abs(t - F.col("_m"))))
    return g.withColumn("score", F.when(F.col("_m").isNotNull(), F.when(mad > 1e-12, -(F.col("total") - F.col("_m")) / mad).otherwise(0.0))).drop("_v", "_m")
