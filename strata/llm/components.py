"""Connected components of a link table by alternating star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.storage import cut


def _star(edges: DataFrame) -> DataFrame:
    """The least of each node and its neighbours becomes the neighbour of all the others."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least.hint("merge"), "u")
    others = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.filter("u != m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (least node of its component), for the nodes that have links."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    state = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.countDistinct("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        # a forest of stars: every node points at a node that points at none
        if tuple(row) == state:
            break
        state = tuple(row)
        now = cut(_star(now))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
