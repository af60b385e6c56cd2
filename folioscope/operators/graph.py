"""Import graphs: bounded reverse reachability, hubs and short cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hubs(edges: DataFrame, most: int = 15) -> DataFrame:
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("out_degree")).where(F.col("out_degree") > most)


def reverse_reach(edges: DataFrame, changed: DataFrame, hops: int = 2, hub_degree: int | None = 15) -> DataFrame:
    """``node, hops``: what imports the changed nodes, directly or not, in the fewest hops.

    Changed nodes themselves and nodes that import too much are left out.
    """
    e = edges.select("src", "dst").distinct()
    if hub_degree is not None:
        e = e.join(hubs(e, hub_degree).select("src"), "src", "left_anti")
    frontier, found = changed.select(F.col("node").alias("dst")).distinct(), []
    for k in range(1, hops + 1):
        step = e.join(frontier, "dst").select(F.col("src").alias("node")).distinct()
        found.append(step.withColumn("hops", F.lit(k).cast("long")))
        frontier = step.select(F.col("node").alias("dst"))
    return reduce(DataFrame.unionByName, found).join(changed.select("node"), "node", "left_anti").groupBy("node").agg(F.min("hops").alias("hops"))


def cycles(edges: DataFrame, most: int = 5) -> DataFrame:
    """Simple cycles of two to ``most`` nodes: ``length, path`` from its smallest node, one for each set of nodes.

    Paths only go on through larger nodes than their first, so that a cycle is met once;
    of cycles through the same nodes the first path stays. No cycle is missed, as a
    search that visits a node once would.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    paths, found = e.where("src < dst").select(F.array("src", "dst").alias("path")), []
    for n in range(2, most + 1):
        at = paths.withColumn("src", F.element_at("path", -1))
        back = at.join(e, "src").where(F.col("dst") == F.col("path")[0])
        found.append(back.select(F.lit(n).cast("long").alias("length"), F.array_join("path", ">").alias("path")))
        if n < most:
            on = at.join(e, "src").where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst")))
            paths = on.select(F.concat("path", F.array("dst")).alias("path"))
    nodes = F.array_sort(F.split("path", ">")).alias("_nodes")
    return reduce(DataFrame.unionByName, found).groupBy("length", nodes).agg(F.min("path").alias("path")).drop("_nodes")
