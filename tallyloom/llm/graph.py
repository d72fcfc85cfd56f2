"""Connected components by contraction: hook every node to its smallest neighbour, follow the hooks, contract.

Each round at least halves the nodes that still have edges; tables shrink, nothing is collected, and a hub
with a third of all nodes only ever meets a table with one row per node (a join that adaptive execution
splits by skew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node it reaches."""
    spark = edges.sparkSession
    clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = materialise(clean, "edges")
    roots = None
    while left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.min("b").alias("m"))
                               .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        while True:
            then = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialise(hook.join(then, "root").select("node", F.col("next").alias("root"),
                                                               (F.col("next") != F.col("root")).alias("moved")), "hooks")
            hook = jumped.select("node", "root")
            if not jumped.where("moved").count():
                break
        if roots is None:
            roots = hook
        else:
            then = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = materialise(roots.join(then, "root", "left")
                                     .select("node", F.coalesce("next", "root").alias("root")), "roots")
        to = hook.select(F.col("node"), F.col("root"))
        left = (left.join(to.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a")
                    .join(to.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b")
                    .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        left = materialise(left, "edges")
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")
