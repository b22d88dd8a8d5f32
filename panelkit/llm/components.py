"""Connected components of a large graph by alternating stars.

Large-star links a node's larger neighbours to the smallest node it knows,
small-star does so with its smaller ones, until the edges stand still as one
star per component (rounds grow with the logarithm of the nodes).  Minima are
combined map-side and kept in the shared folder, so both sides of every join
are plain shuffles, which Spark can split where one node has many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: for every node of an edge, the smallest node it
    reaches.  Loops and repeated edges don't matter."""
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not now[0] or now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("m")))
        # every edge's larger end goes to the smallest node its smaller end knows
        large = cut_lineage(e.join(low, F.col("v") == F.col("node")).select("u", F.col("m").alias("v"))
                            .unionByName(low.filter("node != m").select(F.col("node").alias("u"), F.col("m").alias("v")))
                            .distinct())
        low = cut_lineage(large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")))
        small = large.join(low, F.col("u") == F.col("node"))
        e = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                        .unionByName(low.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())
