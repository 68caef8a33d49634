"""Connected components by repeated contraction.

Every node takes the neighbour (or itself) with the smallest hash as its parent,
edges move to the parents, and edges inside one parent vanish. The hash order is
random, so the graph shrinks by a constant factor a round, whatever the ids look
like. Parents are map-side minima; a node with very many edges is a skewed join
key that Spark splits. Every round is written to the shared folder, which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; nulls and loops are ignored."""
    edges = materialise(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges"
    )
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")
        least = F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("id")))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        parent = materialise(
            both.groupBy("node").agg(least.alias("near")).select("node", F.least(own, "near")["id"].alias("parent")),
            "parents",
        )
        levels.append(parent)
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = materialise(
            moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
        )
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[0].select("node", F.col("parent").alias("root"))
    for level in levels[1:]:
        up = level.select(F.col("node").alias("root"), F.col("parent").alias("up"))
        found = found.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return found
