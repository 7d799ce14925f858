"""Connected components of an edge table: alternating large and small stars.

Every round sends each node's neighbours to a smaller one; edges stay as many as
there are nodes. The rows of a node that most others link to are dealt to several
tasks; groups only ever keep their minimum. The lineage is cut in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node id reachable) for all nodes in edges."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs, "edges")
    while True:
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both.where("v > u"), least.drop("n"), "u", least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        # small star: smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, low.drop("n"), "u", low).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = cut(small, "small-star")
        discard(large)
        same = small.count() == pairs.count() and not small.join(pairs, ["u", "v"], "left_anti").take(1)
        discard(pairs)
        pairs = small
        if same:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
