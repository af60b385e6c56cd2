"""Connected components of an edge table, as alternating star contractions.

Every round groups edges by node, keeps the smallest neighbour and points the
others at it; the table is written to the shared folder after each round, so
that lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import work_dir, written


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a partition by one edge from each node to its local root.

    Works through the partition in chunks, so memory does not grow with it.
    """
    for batch in batches:
        parent: dict = {}

        def root(x):
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in pairs], batch.schema.field(k).type) for k in (0, 1)], names=["u", "v"]
        )


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 40) -> DataFrame:
    """``node, component`` (the smallest node it reaches) for every node of an edge.

    Nulls, loops and repeated edges are ignored. Nodes may be of any type that
    Arrow and ``min`` know. No edges give an empty table.
    """
    spark = edges.sparkSession
    base = work_dir(spark, "components")
    flat = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = written(flat.mapInArrow(_contract, flat.schema).distinct(), f"{base}/0")
    for k in range(1, rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = written(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), f"{base}/{k}")
        parents = now.select(F.col("v").alias("u")).distinct()
        if now.join(parents, "u", "left_semi").isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
