"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, settle, spread_join


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: the root is the component's smallest node.

    Each round points every node at its smallest neighbour, takes two steps along
    the pointers, and joins what is left of the edges to the nodes reached. Every
    component at least halves, so the rounds grow with the logarithm of the
    largest component. Each round's tables are written to the shared folder, and a
    node of very many edges is no single task's work (``spread_join``). An empty edge table gives no rows;
    loops and repeated edges do no harm.
    """
    left = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = settle(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("root")), "roots")
    left = left.where("a < b")
    while count := left.count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "pointer")
        onward = near.select(F.col("a").alias("to"), F.col("to").alias("then"))
        pointer = settle(spread_join(near, onward, "to", 2 * count).select("a", F.coalesce("then", "to").alias("to")), "pointer")
        before = found, left, near, pointer
        found = settle(spread_join(found, pointer.withColumnRenamed("a", "root"), "root").select("node", F.coalesce("to", "root").alias("root")), "roots")
        half = spread_join(left, pointer, "a", count).select(F.col("to").alias("x"), "b")
        moved = spread_join(half, pointer.withColumnRenamed("a", "b"), "b", count).select("x", F.col("to").alias("y"))
        left = settle(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        release(*before)
    return found
