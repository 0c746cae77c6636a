"""Connected components of a graph of links, without gathering links or components on one machine.

Alternates the two star steps: the large one hangs each node's larger neighbours on its smallest neighbour, the small
one its smaller neighbours and itself. A step is a grouped minimum with map-side combination and a join back. Each
round is written to the shared folder, so lost executors cost a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    low = _lowest(down)
    others = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); a component is named by its smallest node.

    No links give an empty table; repeated links and links of a node to itself change nothing.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        seen = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
